"""Purchase listings and documents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import all_of, contains_text, status_label
from storelens.functions.keyed import By, documents, only_shown, page, stretch
from storelens.operators.stock import is_live
from storelens.sources.tables import Tables


def purchase_filter(search: str = "", from_date: dt.date | None = None, to_date: dt.date | None = None) -> Column:
    """Number or reference contains the text, and the date is within both ends."""
    if from_date and to_date and from_date > to_date:
        raise ValueError("from_date is after to_date")
    date = F.col("purchasedate")
    return all_of([
        contains_text("purchase_no", search) | contains_text(F.coalesce("refrence", F.lit("")), search)
        if search else None,
        date >= F.lit(from_date) if from_date else None,
        date < F.lit(to_date + dt.timedelta(days=1)) if to_date else None,
    ])


def purchase_search(t: Tables, search: str = "", from_date: dt.date | None = None,
                    to_date: dt.date | None = None) -> DataFrame:
    """Purchase headers that pass the filter."""
    return t.purchases.where(purchase_filter(search, from_date, to_date))


# Order of the listing.
PURCHASE_ORDER = [By("purchaseid", falling=True)]


def purchase_list(t: Tables, search: str = "", from_date: dt.date | None = None, to_date: dt.date | None = None,
                  number: int = 1, size: int | None = None, after: Sequence | None = None) -> DataFrame:
    """Purchases with the value of their live lines; NULL for one without any."""
    shown = page(purchase_search(t, search, from_date, to_date), PURCHASE_ORDER, number, size, after)
    keys = shown.select(F.col("purchaseid").alias("purchase_id"))
    lines = only_shown(t.ledger.where(is_live()), keys, "purchase_id", size)
    totals = lines.groupBy(F.col("purchase_id").alias("purchaseid")).agg(F.sum("value").alias("totamt"))
    return shown.join(totals, "purchaseid", "left").select(
        "purchaseid", F.date_format("purchasedate", "dd-MM-yyyy").alias("date"), "purchase_no",
        F.coalesce("refrence", F.lit("")).alias("refrence"),
        status_label("cansts", 1, "Cancelled", "Active").alias("status"), "totamt",
    )


def purchase_lines(t: Tables) -> DataFrame:
    """Lines of known unit that are not cancelled; a NULL flag excludes."""
    return t.ledger.where(F.col("itmcandel") == 0).join(t.units, "unitid").select(
        "purchase_id", "orderid", "line_no", F.col("itmid").alias("item_id"), "unitid", "unitname",
        F.col("stockqty").alias("quantity"), "value",
    )


def purchase_document(t: Tables, page_rows: int = 1000) -> DataFrame:
    """Purchase with its lines, in lists of at most ``page_rows``."""
    def item(row: Column, _: Column) -> Column:
        return F.struct(row["item_id"].alias("item_id"), row["unitid"].alias("unit_id"),
                        row["unitname"].alias("unit_name"), row["quantity"].alias("quantity"),
                        row["value"].alias("value"))

    header = t.purchases.select(
        F.col("purchaseid").alias("purchase_id"), "purchase_no",
        F.col("purchasedate").alias("purchase_date"), F.coalesce("refrence", F.lit("")).alias("reference"),
    )
    return documents(
        header, purchase_lines(t), "purchase_id", ["orderid", "line_no", "item_id", "quantity", "value"],
        {"_stretch": F.coalesce(stretch("orderid", 10), F.lit(-1))}, item, page_rows, "purchase_items",
    )

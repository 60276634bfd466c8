"""Stock on hand from an append-only ledger of signed movements."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import contains_text
from storelens.functions.keyed import By, only_shown, page
from storelens.operators.images import first_image_per_product
from storelens.sources.tables import Tables

# Fixed value: opening date taken for products that have none.
DEFAULT_OPEN_DATE = dt.date(2020, 1, 1)


def is_live() -> Column:
    """Ledger rows that still count: neither the line nor its order is cancelled."""
    return (F.coalesce("itmcandel", F.lit(0)) == 0) & (F.coalesce("canordersts", F.lit(0)) == 0)


def signed_quantity() -> Column:
    """Inward counts up, outward down; a row that is both counts as inward."""
    return (
        F.when(F.col("instoreid") > 0, F.col("stockqty"))
        .when(F.col("outstoreid") > 0, -F.col("stockqty"))
        .otherwise(0)
    )


def condensed(ledger: DataFrame) -> DataFrame:
    """Ledger lines added up by all that the stock operators look at: item, day, directions and cancel marks."""
    direction = lambda c: F.when(F.col(c) > 0, 1).otherwise(0).alias(c)
    return ledger.groupBy(
        "itmid", "purchase_date", direction("instoreid"), direction("outstoreid"), "itmcandel", "canordersts",
    ).agg(F.sum("stockqty").alias("stockqty"))


def daily_movements(ledger: DataFrame) -> DataFrame:
    """Net live movement per item and day: at most one row per item and day goes on."""
    return (
        ledger.where(is_live())
        .groupBy("itmid", "purchase_date")
        .agg(F.sum(signed_quantity()).alias("moved"))
    )


def since_opening(t: Tables, daily: DataFrame, default_open_date: dt.date, *sums: str) -> DataFrame:
    """Daily sums of each product added up from its opening date on."""
    opened = t.products.select(
        F.col("product_id"),
        F.coalesce("openbaldate", F.lit(default_open_date)).alias("opened"),
    )
    return (
        daily.withColumnRenamed("itmid", "product_id")
        .join(opened, "product_id")
        .where(F.col("purchase_date") >= F.col("opened"))
        .groupBy("product_id")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )


def with_movement(t: Tables, products: DataFrame, default_open_date: dt.date = DEFAULT_OPEN_DATE,
                  chosen: bool = False) -> DataFrame:
    """Products with ``moved``, the net live movement since their opening date (NULL if none).

    ``chosen`` says that the products are a selection: then only their rows of
    the ledger are summed up.
    """
    ledger = t.ledger
    if chosen:
        ledger = ledger.join(products.select(F.col("product_id").alias("itmid")), "itmid", "left_semi")
    moved = since_opening(t, daily_movements(ledger), default_open_date, "moved")
    return products.join(moved, "product_id", "left")


def with_stock(t: Tables, products: DataFrame, default_open_date: dt.date = DEFAULT_OPEN_DATE,
               chosen: bool = False) -> DataFrame:
    """Products with ``stock``: opening balance plus movement, nothing missing counted as zero."""
    return with_movement(t, products, default_open_date, chosen).withColumn(
        "stock", F.coalesce("openbalqty", F.lit(0)) + F.coalesce("moved", F.lit(0))
    ).drop("moved")


def stock_ledger(t: Tables, default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """Current stock of every product."""
    products = t.products.select("product_id", "title", "lowstqty", "itmsts", "openbalqty")
    return with_stock(t, products, default_open_date)


def stock_state_filter(stock: DataFrame, state: str) -> DataFrame:
    """Active products that are ``low``, ``out``, or ``all``."""
    active = stock.where(F.col("itmsts") == 1)
    if state == "low":
        return active.where((F.col("stock") > 0) & (F.col("stock") <= F.coalesce("lowstqty", F.lit(0))))
    if state == "out":
        return active.where(F.col("stock") <= 0)
    return active


# Order of the listing.
STOCK_ORDER = [By("product_id", falling=True)]


def low_stock_list(t: Tables, state: str = "low", search: str = "", number: int = 1, size: int | None = None,
                   default_open_date: dt.date = DEFAULT_OPEN_DATE, after: Sequence | None = None) -> DataFrame:
    """Stock listing, newest product first, with the first image of each product."""
    products = t.products.select("product_id", "title", "lowstqty", "itmsts", "openbalqty")
    if search.strip():
        products = products.where(contains_text("title", search))
    found = stock_state_filter(with_stock(t, products, default_open_date, bool(search.strip())), state)
    shown = page(found, STOCK_ORDER, number, size, after)
    images = only_shown(t.images, shown, "product_id", size)
    return (
        shown.join(first_image_per_product(images), "product_id", "left")
        .select(
            F.col("product_id").alias("id"), F.col("title").alias("name"), "lowstqty", "itmsts", "stock",
            F.coalesce("image_url", F.lit("")).alias("image"),
        )
    )


def low_stock_total(t: Tables, state: str = "low", search: str = "",
                    default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """Row count that goes with the listing."""
    products = t.products.select("product_id", "title", "lowstqty", "itmsts", "openbalqty")
    if search.strip():
        products = products.where(contains_text("title", search))
    found = stock_state_filter(with_stock(t, products, default_open_date, bool(search.strip())), state)
    return found.agg(F.count(F.lit(1)).alias("total"))


def dashboard_low_stock(t: Tables, size: int = 5, default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """Dashboard tile: the low products with most stock.

    Its low test adds the opening balance to a stock that already holds it, and
    a product without an opening balance never shows.
    """
    tested = F.col("openbalqty") + F.col("stock")
    low = (tested > 0) & (tested <= F.coalesce("lowstqty", F.lit(0)))
    top = (
        stock_ledger(t, default_open_date)
        .where((F.col("itmsts") == 1) & low)
        .orderBy(F.col("stock").desc(), "product_id")
        .limit(size)
    )
    return (
        top.join(first_image_per_product(t.images), "product_id", "left")
        .select(
            F.col("product_id").alias("id"), F.col("title").alias("name"), "lowstqty", "itmsts",
            "openbalqty", "stock", F.coalesce("image_url", F.lit("")).alias("image"),
        )
    )


def stock_report(t: Tables, kind: str = "all", default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """Inward, outward and closing quantity per product.

    Unlike the ledger: a NULL cancel flag excludes the row, order cancellation
    is not looked at, a row that is both inward and outward counts on both
    sides, and a missing opening balance leaves the closing stock NULL.
    """
    daily = (
        t.ledger.where(F.col("itmcandel") == 0)
        .groupBy("itmid", "purchase_date")
        .agg(
            F.sum(F.when(F.col("instoreid") > 0, F.col("stockqty"))).alias("in_qty"),
            F.sum(F.when(F.col("outstoreid") > 0, F.col("stockqty"))).alias("out_qty"),
        )
    )
    sums = since_opening(t, daily, default_open_date, "in_qty", "out_qty")
    report = (
        t.products.select("product_id", "title", "openbalqty")
        .join(sums, "product_id", "left")
        .withColumns({
            "in_qty": F.coalesce("in_qty", F.lit(0)),
            "out_qty": F.coalesce("out_qty", F.lit(0)),
        })
        .withColumn("current_stock", F.col("openbalqty") + F.col("in_qty") - F.col("out_qty"))
    )
    if kind == "in":
        return report.where(F.col("current_stock") > 0)
    if kind == "out":
        return report.where(F.col("current_stock") == 0)
    return report

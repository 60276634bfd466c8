"""Invoices as data: header, line text and the text behind the code on the sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.keyed import spread_join
from storelens.operators.orders import line_documents
from storelens.operators.people import latest_address_per_user
from storelens.sources.tables import Tables

TRACKING_LINK = "https://orders.example.com/order/"

# The texts of an invoice.
MISSING = "N/A"
NUMBER_MARK = ". "
QUANTITY_MARK = "  x"
AMOUNT_MARK = "  ₹"
TOTAL_MARK = "Total Amount: ₹"
MAP_LINK = "https://www.google.com/maps/search/?api=1&query="


def invoice_header(t: Tables) -> DataFrame:
    """Order with the customer of its latest address, ``N/A`` where something is missing."""
    customer = latest_address_per_user(t.addresses, "name", "phone", "full_address")
    missing = F.lit(MISSING)
    return spread_join(t.orders, customer, ["user_id"], ["order_id"]).select(
        "order_id", "order_no", "total_amount", "created_at",
        F.coalesce("name", missing).alias("customer_name"),
        F.coalesce("phone", missing).alias("phone"),
        F.coalesce("full_address", missing).alias("full_address"),
    )


def _invoice_lines(t: Tables) -> DataFrame:
    return t.order_items.select("order_id", "line_no", "product_id", "product_qty", "product_amount", "product_name")


def invoice_document(t: Tables, page_rows: int = 1000) -> DataFrame:
    """Invoice header with its lines, in lists of at most ``page_rows``."""
    def item(row: Column, position: Column) -> Column:
        return F.struct(position.alias("position"), row["product_name"].alias("product_name"),
                        row["product_qty"].alias("product_qty"), row["product_amount"].alias("product_amount"))

    return line_documents(invoice_header(t), _invoice_lines(t), item, page_rows, "items")


def _link_text(text: Column) -> Column:
    """Percent-encoding of an address for a map link."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return encoded


def invoice_text(t: Tables, page_rows: int = 1000, tracking_link: str = TRACKING_LINK) -> DataFrame:
    """Lines of each invoice page, and the link for delivery or pickup."""
    def line(row: Column, position: Column) -> Column:
        return F.concat(
            position.cast("string"), F.lit(NUMBER_MARK), row["product_name"],
            F.lit(QUANTITY_MARK), row["product_qty"].cast("string"), F.lit(AMOUNT_MARK), row["product_amount"].cast("string"),
        )

    delivery = F.col("full_address") != MISSING
    map_link = F.concat(F.lit(MAP_LINK), _link_text(F.col("full_address")))
    return line_documents(invoice_header(t), _invoice_lines(t), line, page_rows, "lines").select(
        "order_id", "page_no",
        F.when(delivery, "delivery").otherwise("pickup").alias("kind"),
        F.array_join("lines", "\n").alias("items_text"),
        F.when(delivery, map_link).otherwise(F.concat(F.lit(tracking_link), F.col("order_no"))).alias("link"),
        F.concat(F.lit(TOTAL_MARK), F.col("total_amount").cast("string")).alias("total_text"),
    )

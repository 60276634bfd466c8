"""Readers for tables, item sheets and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.columns import blank_to

ITEM_SHEET = (
    "title string, categoriesname string, description string,"
    " price decimal(10,2), mrp decimal(10,2), quantity int, unit string"
)

ORDER_DOCUMENT = (
    "order_id bigint, part_no int, user_id bigint, address_delivery string, total_amount decimal(12,2),"
    " order_status string, payment_status string, payment_method string, delivery_id int,"
    " delivery_start string, coupon_code string, transaction_id string,"
    " items_details array<struct<product_id: bigint, product_name: string, product_unit: int,"
    " product_qty: int, product_rate: decimal(12,2), product_amount: decimal(12,2),"
    " discount_amt: decimal(12,2), discount_per: decimal(12,2)>>"
)

PURCHASE_DOCUMENT = (
    "purchase_id bigint, purchase_header struct<purchase_date: date>,"
    " purchase_items array<struct<item_id: bigint, item_name: string, unit_id: int, quantity: int,"
    " rate: decimal(12,2), value: decimal(12,2), instore_id: int, outstore_id: int, can_order_status: int>>"
)

FLASH_SALE_DOCUMENT = (
    "from_datetime timestamp_ntz, to_datetime timestamp_ntz,"
    " items_details array<struct<product_id: bigint, product_rate: decimal(10,2)>>"
)


def table_source(spark: SparkSession, location: str, kind: str = "parquet", **options) -> DataFrame:
    """A stored table. ``kind`` is any reader Spark has, ``jdbc`` included."""
    reader = spark.read.format(kind).options(**options)
    return reader.load() if kind == "jdbc" else reader.load(location)


def bulk_item_scan(spark: SparkSession, path: str) -> DataFrame:
    """Item sheet saved as CSV with a header row; a sheet without rows is an error."""
    sheet = clean_sheet(spark.read.csv(path, header=True, schema=ITEM_SHEET, enforceSchema=False))
    if sheet.isEmpty():
        raise ValueError("the sheet contains no data")
    return sheet


def clean_sheet(sheet: DataFrame) -> DataFrame:
    """Sheet rows with missing texts as empty and missing numbers as zero."""
    texts = ("title", "categoriesname", "description", "unit")
    numbers = ("price", "mrp", "quantity")
    return sheet.withColumns({
        **{c: blank_to(c, "") for c in texts},
        **{c: F.coalesce(F.col(c), F.lit(0)).cast(sheet.schema[c].dataType) for c in numbers},
    })


def nested_scan(documents: DataFrame, schema: str, items: str, column: str = "document",
                carry: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Header rows and item rows of JSON documents; a document without items keeps one empty item row.

    ``carry`` names header values that the item rows take along.
    """
    parsed = documents.withColumn("_d", F.from_json(column, schema)).drop(column)
    kept = [c for c in parsed.columns if c != "_d"]
    wide = parsed.select(*kept, "_d.*")
    headers = wide.drop(items)
    kept += list(carry or {})
    parsed = parsed.withColumns({name: F.col(f"_d.{path}") for name, path in (carry or {}).items()})
    rows = parsed.select(*kept, F.posexplode_outer(F.col(f"_d.{items}")).alias("item_no", "_item"))
    return headers, rows.select(*kept, "item_no", "_item.*")


def nested_order_scan(documents: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """Headers and lines of submitted orders.

    A long order may come in several documents numbered by ``part_no``; the
    first one (0 or no number) gives the header.
    """
    headers, lines = nested_scan(documents.select(column), ORDER_DOCUMENT, "items_details", column, {
        "order_id": "order_id", "part_no": "part_no", "user_id": "user_id", "total_amount": "total_amount"})
    first = F.coalesce("part_no", F.lit(0)) == 0
    return headers.where(first).drop("part_no"), lines

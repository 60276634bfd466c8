"""Loading item sheets and nested catalogue, purchase and flash-sale documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.keyed import stretch
from storelens.operators.catalogue import missing_members
from storelens.operators.numbering import document_number, next_keys
from storelens.sources.readers import FLASH_SALE_DOCUMENT, PURCHASE_DOCUMENT, clean_sheet, nested_scan
from storelens.sources.tables import Tables

# Fixed value: unit of a sheet row whose unit text matches nothing.
FALLBACK_UNIT = 7


def _keys_by_digest(members: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys for new names in the order of their digests, which spread evenly whatever the names are."""
    digest = F.md5(F.coalesce("member", F.lit("")).cast("binary"))
    order = [digest, F.col("member").asc_nulls_first()]
    return next_keys(members, existing, key, order, {"_digest": F.substring(digest, 1, 4)})


def bulk_item_load(t: Tables, sheet: DataFrame) -> dict[str, DataFrame]:
    """Categories, units and products that an item sheet adds to the catalogue.

    ``sheet`` has the sheet columns and trnid, the row number. Products whose
    trimmed title is known are not loaded; repeats within the sheet all are.
    """
    staged = clean_sheet(sheet)
    members = missing_members(staged, "categoriesname", t.categories, "categories_name")
    categories = _keys_by_digest(members, t.categories, "categories_id").select(
        "categories_id", F.col("member").alias("categories_name"), F.lit(1).alias("cat_sts")
    )
    members = missing_members(staged, "unit", t.units, "unitshortcode")
    units = _keys_by_digest(members, t.units, "unitid").select(
        "unitid", F.col("member").alias("unitshortcode"), F.col("member").alias("unitname"),
        F.lit(1).alias("isbaseunit"), F.lit(0).alias("baseunitid"), F.lit(100).alias("decimalbasefactor"),
    )
    all_categories = t.categories.select("categories_id", F.trim("categories_name").alias("_category")).unionByName(
        categories.select("categories_id", F.trim("categories_name").alias("_category"))
    )
    all_units = t.units.select("unitid", F.trim("unitshortcode").alias("_unit")).unionByName(
        units.select("unitid", F.trim("unitshortcode").alias("_unit"))
    )
    known = t.products.where("title is not null").select(F.trim("title").alias("_title")).distinct()
    fresh = (
        staged.withColumns({"_title": F.trim("title"), "_category": F.trim("categoriesname"), "_unit": F.trim("unit")})
        .join(known, "_title", "left_anti")
        .join(all_categories, "_category", "left")
        .join(all_units, "_unit", "left")
    )
    products = next_keys(
        fresh, t.products, "product_id", [F.col("trnid"), F.col("categories_id"), F.col("unitid")],
        {"_stretch": stretch("trnid")},
    ).select(
        "product_id", "trnid", F.coalesce("categories_id", F.lit(0)).alias("categories_id"), "title", "description",
        "price", "mrp", "quantity", F.coalesce("unitid", F.lit(FALLBACK_UNIT)).alias("unit"),
    )
    return {"categories": categories, "units": units, "products": products}


def category_product_load(t: Tables, documents: DataFrame) -> dict[str, DataFrame]:
    """Nested category with one product and its pictures, as rows for three tables.

    ``documents``: seq, category_name, title, description, price, mrp,
    quantity, thumbnail, images. Documents lacking a required field are left out.
    """
    required = ("category_name", "title", "price", "mrp", "quantity", "thumbnail")
    complete = documents
    for column in required:
        # A number must not be zero, a text not empty; the text "0" is one.
        missing = "" if isinstance(documents.schema[column].dataType, T.StringType) else 0
        complete = complete.where(F.col(column) != missing)
    order, bucket = [F.col("seq")], {"_stretch": stretch("seq")}
    keyed = next_keys(complete, t.categories, "categories_id", order, bucket)
    keyed = next_keys(keyed, t.products, "product_id", order, bucket)
    return {
        "categories": keyed.select("categories_id", F.col("category_name").alias("categories_name")),
        "products": keyed.select("product_id", "categories_id", "title", "description", "price", "mrp",
                                 "quantity", "thumbnail"),
        "images": keyed.select("product_id", F.explode("images").alias("image_url")),
    }


def purchase_post(documents: DataFrame, register_id: str = "register_id", prefix: str = "PUR", last: int = 1,
                  digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Purchase headers with their number, and inward ledger lines, of submitted purchases.

    ``documents``: seq, the store column and ``document``, JSON text.
    """
    headers, items = nested_scan(documents, PURCHASE_DOCUMENT, "purchase_items",
                                 carry={"purchase_date": "purchase_header.purchase_date"})
    numbered = document_number(headers, "seq", prefix, last, digits, by=[register_id], count_from_last=True,
                               name="purchase_no")
    header_rows = numbered.select(
        "seq", F.col(register_id).alias("storeid"), "purchase_no",
        F.col("purchase_header.purchase_date").alias("purchasedate"),
    )
    lines = items.where("item_no is not null").select(
        "seq", "item_no", "purchase_date", F.col("instore_id").alias("instoreid"),
        F.col("outstore_id").alias("outstoreid"), F.col("item_id").alias("itmid"),
        F.col("item_name").alias("itmname"), F.col("unit_id").alias("unitid"), F.col("quantity").alias("stockqty"),
        "rate", "value", F.col("quantity").alias("currentstock"), F.lit(0).alias("canordersts"),
    )
    return header_rows, lines


def flash_sale_post(documents: DataFrame, register_id: str = "register_id", prefix: str = "FLS", last: int = 0,
                    digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Flash-sale headers with their number, and their product lines."""
    headers, items = nested_scan(documents, FLASH_SALE_DOCUMENT, "items_details")
    numbered = document_number(headers, "seq", prefix, last, digits, by=[register_id], name="flash_no")
    lines = items.where("item_no is not null").select("seq", "item_no", "product_id", "product_rate")
    return numbered.select("seq", register_id, "flash_no", "from_datetime", "to_datetime"), lines

"""First reason why a submitted row is refused; NULL for a row that is fine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validated(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Rows with ``reason``, the text of the first rule that holds."""
    reason = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        reason = F.when(broken, text).otherwise(reason)
    return rows.withColumn("reason", reason)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and refused rows with their reason."""
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


# The reasons below are the messages a client is shown.


def check_addresses(rows: DataFrame) -> DataFrame:
    return validated(rows, [
        (_blank("name"), "Name is required"),
        (_empty("phone"), "Phone number is required"),
        (~F.col("phone").rlike("^[0-9]{10}$"), "Phone number must be exactly 10 digits"),
    ])


def check_items(rows: DataFrame) -> DataFrame:
    return validated(rows, [
        (_blank("name"), "Item name is required"),
        (_empty("category"), "Category is required"),
        (_empty("unit"), "Unit is required"),
    ])


def check_coupons(rows: DataFrame) -> DataFrame:
    missing = _empty("coupon_code") | _empty("discount_type") | (F.coalesce("discount_value", F.lit(0)) == 0)
    return validated(rows, [
        (missing, "Coupon code, type and value are required"),
        (~F.col("discount_type").isin("PERCENT", "FLAT"), "Invalid discount type"),
    ])


def check_orders(rows: DataFrame) -> DataFrame:
    no_address = _empty("address_delivery") | (F.col("address_delivery") == "0")
    return validated(rows, [
        (no_address, "Please add or select a delivery address before placing order"),
        (_empty("delivery_start"), "Delivery time required"),
        (F.col("delivery_start") == "Immediate", "Delivery end time missing"),
    ])

"""Column rules shared by the operators."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def contains_text(column: str | Column, text: str) -> Column:
    """Case-blind substring test; ``%`` and ``_`` in the text are wildcards."""
    return col(column).ilike(f"%{text}%")


def all_of(conditions: Iterable[Column | None]) -> Column:
    """AND of the conditions that are given; true if none is."""
    return functools.reduce(operator.and_, [c for c in conditions if c is not None], F.lit(True))


def blank_to(column: str | Column, default) -> Column:
    """Default for NULL and for the empty text."""
    return F.coalesce(F.nullif(col(column), F.lit("")), F.lit(default))


def pad_number(number: Column, digits: int) -> Column:
    """Zero-padded digits; a longer number is kept whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def order_number(value: Column) -> Column:
    """Digits of a text order reference as a number; NULL if it has none."""
    return F.regexp_replace(value, "[^0-9]", "").try_cast("long")


def percent_off(price: Column, percent: Column) -> Column:
    """Price after a percentage, rounded half up to cents, in decimals throughout."""
    left = (F.lit(100).cast("decimal(5,2)") - percent) * F.lit("0.01").cast("decimal(3,2)")
    return F.round(price * left, 2)


def status_label(flag: str | Column, value: int, text: str, other: str) -> Column:
    return F.when(col(flag) == value, text).otherwise(other)


def order_bucket(status: str | Column, case_sensitive: bool = False) -> Column:
    """Order screen an order belongs to; NULL if to none."""
    value = col(status)
    if case_sensitive:
        processed = value.isin("Process", "Pending")
    else:
        value = F.lower(value)
        processed = value.isin("pending", "process", "out_for_delivery")
    return (
        F.when(processed, "processed")
        .when(value == "delivered", "delivered")
        .when(value == "cancelled", "cancelled")
    )


def hmac_sha256(message: Column, secret: str) -> Column:
    """Keyed SHA-256 of a text column as lower-case hex.

    Spark has no keyed hash; the two padded keys are constants of the query.
    """
    key = secret.encode()
    if len(key) > 64:
        raise ValueError("secrets longer than one hash block are not supported")
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)

"""Document numbers and row keys handed out in submission order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import pad_number
from storelens.functions.keyed import ranked, stretch


def document_number(rows: DataFrame, seq: str, prefix: str = "ORD", last: int = 0, digits: int = 4,
                    by: Sequence[str] = (), count_from_last: bool = False, name: str = "document_no") -> DataFrame:
    """Number the rows of each store in the order of the whole-number column ``seq``.

    Orders and flash sales start after ``last``; purchases start at it
    (``count_from_last``). Padding never cuts a longer number.
    """
    start = last - 1 if count_from_last else last
    numbered = ranked(rows, by=list(by), order=[F.col(seq)], bucket={"_stretch": stretch(seq)}, name="_no")
    text = F.concat(F.lit(prefix), pad_number(F.col("_no") + start, digits))
    return numbered.withColumn(name, text).drop("_no")


def next_keys(rows: DataFrame, existing: DataFrame, key: str, order: Sequence[Column],
              bucket: dict[str, Column]) -> DataFrame:
    """Keys after the highest existing one, in the given order."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("top"))
    numbered = ranked(rows, by=[], order=order, bucket=bucket, name="_no")
    return numbered.withColumn(key, F.col("_no") + top.scalar()).drop("_no")

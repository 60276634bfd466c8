"""Every operator as a query over the supplied tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.sources.binding import StarSchema
from storelens.sources.tables import Tables

AS_OF = dt.date(2001, 7, 31)
OPEN_DATE = dt.date(1995, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Values in types that any reader compares alike."""
    def shown(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.IntegralType):
            col = col.cast("long")
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return col.alias(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def query(name: str):
    """Register a function of the logical tables under a query name."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: plain(build(StarSchema(spark, folder).tables()))
        return build
    return register


def star_query(name: str):
    """Register a function of the source schema, for inputs that are no store table."""
    def register(build: Callable[[StarSchema], DataFrame]) -> Callable[[StarSchema], DataFrame]:
        QUERIES[name] = lambda spark, folder: plain(build(StarSchema(spark, folder)))
        return build
    return register

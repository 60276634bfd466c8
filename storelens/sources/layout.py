"""Tables laid out by store, so that one store's request reads that store's files.

Each table with an owner is written with the number of its store as a partition column; a table that names its store in a
column of its own, too. Rows are dealt out by ranges of store and key: a task writes a few stores, and a store
that holds much of a table is written by as many tasks as its rows need. Rows whose owner is unknown belong to no store.
Tables that all stores share are written as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.tables import TABLE_NAMES, Tables
from storelens.sources.tenancy import OWN_COLUMN, OWNERS, register

STORE = "of_store"


def with_store(t: Tables, table: str) -> DataFrame:
    """A table with the store of each row; as it is, if it has no owner."""
    rows = getattr(t, table)
    own = OWN_COLUMN.get(table, "register_id")
    if own in rows.columns:
        return rows.withColumn(STORE, F.col(own))
    if table not in OWNERS:
        return rows
    owner, column, key = OWNERS[table]
    owners = with_store(t, owner)
    if STORE not in owners.columns:
        return rows
    # An owner that stands in several stores hands its rows to all of them, as a scan of each would find them.
    return rows.join(owners.select(F.col(key).alias(column), STORE).distinct(), column, "left").select(*rows.columns, STORE)


def write_by_store(t: Tables, folder: str, names: Iterable[str] = TABLE_NAMES) -> None:
    """Write tables under ``folder``, each parted by store if it has one; what lies there is replaced."""
    for name in names:
        rows = with_store(t, name)
        if STORE in rows.columns:
            # The first columns of a table are its keys; within a store they spread a large one over tasks.
            rows.repartitionByRange(STORE, *[F.col(c) for c in rows.columns[:2]]).write.mode("overwrite").partitionBy(STORE).parquet(
                f"{folder}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_store(spark: SparkSession, folder: str, table: str, register_id: int) -> DataFrame:
    """The rows of a table that a store sees; other stores' files are not opened."""
    rows = spark.read.parquet(f"{folder}/{table}")
    return rows.where(F.col(STORE) == register_id).drop(STORE) if STORE in rows.columns else rows


def stored_tables(spark: SparkSession, folder: str, register_id: int, names: Iterable[str] = TABLE_NAMES) -> Tables:
    """The tables written by ``write_by_store`` as a registered store sees them, for any operator."""
    if "tenants" in names:
        register(Tables(tenants=spark.read.parquet(f"{folder}/tenants").drop(STORE)), register_id)
    return Tables(**{name: (lambda name=name: read_store(spark, folder, name, register_id)) for name in names})

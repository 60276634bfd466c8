"""Streaming forms of the order feed, revenue, stock and order status; ``carts`` has that of the cart.

Each job runs over whatever has arrived and stops (``availableNow``), or keeps
running with the trigger it is given. No job depends on the order of arrival:
sums and latest rows fold in any order, so a stream gives what its batch form
gives over the finished input. State and sinks lie in a shared folder, so a lost executor or a restart
resumes from the last finished batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storelens.operators.stock import is_live, signed_quantity

NOW = {"availableNow": True}

# Number of batches from one state written out whole to the next.
WHOLE_EVERY = 32

Fold = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    # As a pattern, the path may name a file: the source takes a plain path for a folder.
    path = f"{folder}/{name[:-1]}[{name[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def folder_of(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def batch_numbers(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches written so far."""
    fs, at = folder_of(spark, f"{target}/rows")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def write_batches(stream: DataFrame, target: str, trigger: dict | None = None,
                  change: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Write each micro-batch to its own folder; a batch that is run again replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = change(rows, batch) if change else rows
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={batch}")

    return (
        stream.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(**(trigger or NOW)).start()
    )


def read_batches(spark: SparkSession, target: str, schema, since: int = 0, before: int | None = None) -> DataFrame:
    """Rows of the batches in a range; none if no batch was written."""
    chosen = [b for b in batch_numbers(spark, target) if b >= since and (before is None or b < before)]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{target}/rows/batch={b}" for b in chosen])


def fold_stream(stream: DataFrame, target: str, fold: Fold, trigger: dict | None = None) -> StreamingQuery:
    """Keep a folded state up to date: each batch writes what it folds to, every ``WHOLE_EVERY`` batches the whole state.

    ``fold`` brings rows down to fewer rows of the same columns and may be
    applied in any order and to its own results. Batches that no reader and no
    repeated batch needs any more are removed.
    """
    spark, schema = stream.sparkSession, stream.schema

    def step(rows: DataFrame, batch: int) -> DataFrame:
        if batch % WHOLE_EVERY:
            return fold(rows)
        for old in [b for b in batch_numbers(spark, target) if b < batch - WHOLE_EVERY]:
            fs, at = folder_of(spark, f"{target}/rows/batch={old}")
            fs.delete(at, True)
        return fold(fold(rows).select(*schema.names).unionByName(
            read_batches(spark, target, schema, max(0, batch - WHOLE_EVERY), batch)))

    return write_batches(stream, target, trigger, lambda rows, batch: step(rows, batch).select(*schema.names))


def read_folded(spark: SparkSession, target: str, fold: Fold, schema) -> DataFrame:
    """The state after the last finished batch."""
    written = batch_numbers(spark, target)
    whole = written[-1] // WHOLE_EVERY * WHOLE_EVERY if written else 0
    return fold(read_batches(spark, target, schema, whole))


def new_order_feed(orders: DataFrame) -> DataFrame:
    """One message per accepted order."""
    return orders.select("order_id", "register_id", "total_amount")


def daily_revenue_rows(orders: DataFrame) -> DataFrame:
    """Each order's share in the revenue of its day."""
    return orders.select(F.to_date("created_at").alias("day"), F.lit(1).cast("long").alias("orders"),
                         F.col("total_amount").cast("decimal(38,2)").alias("revenue"))


def daily_revenue(rows: DataFrame) -> DataFrame:
    """Order count and value per day. Sums of batches add up, so no order comes too late."""
    return rows.groupBy("day").agg(F.sum("orders").alias("orders"), F.sum("revenue").cast("decimal(38,2)").alias("revenue"))


def stock_movement_rows(ledger: DataFrame) -> DataFrame:
    """Each ledger line's signed quantity."""
    return ledger.where(is_live()).select("itmid", "purchase_date", signed_quantity().cast("long").alias("moved"))


def stock_movements(rows: DataFrame) -> DataFrame:
    """Net movement per item and day.

    The state is the pre-reduced ledger of the batch operator: products and
    opening dates meet it when it is read, so no busy item is ever joined row
    by row.
    """
    return rows.groupBy("itmid", "purchase_date").agg(F.sum("moved").alias("moved"))


def order_status_rows(tracking: DataFrame) -> DataFrame:
    """Each tracking row as a candidate for its order's status."""
    return tracking.select("order_id", F.struct("created_at", "id", F.lower("status").alias("status")).alias("last"))


def order_statuses(rows: DataFrame) -> DataFrame:
    """The latest candidate of each order, whenever it arrived."""
    return rows.groupBy("order_id").agg(F.max("last").alias("last"))

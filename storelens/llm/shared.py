"""Tables written between steps, joins of hot keys and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.plans.session import shared_folder


def workers_find_library(spark: SparkSession) -> None:
    """Let local Python workers import this library from where the driver has it; on a cluster it is deployed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again, so that later steps don't compute them anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table of ``written`` that no later step reads."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def laid_by(df: DataFrame, key: str, only: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows whose ``key`` is in ``only`` (each key once), written to buckets of the key: joins by it don't move them.

    They are a table of the session's catalog with its files in the shared folder, removed when the block ends."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    # Rows are dealt by the key before the join, so that one task writes the one file of a bucket.
    rows = df.repartition(buckets, key).join(only, key)
    rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    try:
        out = spark.table(table)
        out.written_to = path
        yield out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        dropped(out)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str, how: str = "inner",
                shares: int = 8) -> DataFrame:
    """Join rows with a table that has one row for each key, each key's rows dealt to ``shares`` tasks by ``spread``."""
    left = left.withColumn("share_", F.pmod(F.xxhash64(spread), F.lit(shares)))
    right = right.withColumn("share_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return left.join(right, [*keys, "share_"], how).drop("share_")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Each node of the links (a, b) with the smallest node that it can reach: (node, root).

    Every round links the larger neighbours of each node, then the smaller ones, to the smallest node around, until
    every link goes straight to a smallest node. A node's neighbours are never gathered: their smallest is an
    aggregate and goes back to the links by a join that deals out the links of a node with many.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = written(edges.where("a <> b").select(pair(F.col("a"), F.col("b")).alias("l")).select("l.*").distinct(), name)
    mark = _mark(now)
    while True:
        # Larger neighbours to the smallest.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        step = written(large, name)
        # Smaller neighbours, and the node itself, to the smallest.
        least = step.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(step, least, ["a"], "b").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("l")).select("l.*").where("a <> b").distinct()
        after = written(small, name)
        seen = _mark(after)
        dropped(now)
        dropped(step)
        now = after
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def _mark(links: DataFrame) -> tuple:
    """Count and two sums of hashes that tell whether a round changed anything."""
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
    ).first())

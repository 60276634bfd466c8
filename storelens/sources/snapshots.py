"""Stock ledger kept summed up beside its files, and brought forward by new files only.

A ledger grows by files and its old files don't change. Its lines are condensed to what the stock operators look at: one
line for each item, day, direction and pair of cancel marks, with the quantities added up. Condensed lines are ledger lines
themselves, so every operator over the ledger's quantities runs on them unchanged, and condensing them again adds sums.

A snapshot is a row of parts. Bringing it forward reads the files that no part has seen and writes them, condensed, as a new part;
every ``MERGE_EVERY`` parts are condensed into one. A part counts once its mark is written, so a run that fails leaves the
snapshot as it was. A read takes the parts and condenses files that are newer still. A file that has gone (the
ledger was written anew) voids the snapshot, and the next run starts over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.stock import condensed

MERGE_EVERY = 16


@dataclass(frozen=True)
class Part:
    """A part, named by its number and the first of the parts that it stands for."""

    number: int
    first: int


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _at(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def ledger_files(spark: SparkSession, ledger: str) -> set[str]:
    return {n for n in _names(spark, ledger) if not n.startswith(("_", "."))}


def parts(spark: SparkSession, snapshot: str) -> list[Part]:
    """The parts that count, newest first: none that a later one stands for."""
    found = sorted((Part(*map(int, n.split("_")[1:])) for n in _names(spark, f"{snapshot}/done") if n.startswith("part_")),
                   key=lambda p: -p.number)
    out: list[Part] = []
    for p in found:
        if not out or p.number < out[-1].first:
            out.append(p)
    return out


def seen_files(spark: SparkSession, snapshot: str) -> set[str]:
    paths = [f"{snapshot}/part={p.number}/files" for p in parts(spark, snapshot)]
    return {r["name"] for r in spark.read.schema("name string").parquet(*paths).collect()} if paths else set()


def _sums(spark: SparkSession, snapshot: str, which: list[Part], schema) -> list[DataFrame]:
    return [spark.read.schema(schema).parquet(f"{snapshot}/part={p.number}/sums") for p in which]


def _new_lines(spark: SparkSession, ledger: str, names: set[str], schema) -> DataFrame:
    return condensed(spark.read.schema(schema).parquet(*[f"{ledger}/{n}" for n in sorted(names)]))


def bring_forward(spark: SparkSession, ledger: str, snapshot: str, schema) -> set[str]:
    """Take new files of a ledger folder into its snapshot; gives the names of the files that were read."""
    there, seen, now = ledger_files(spark, ledger), seen_files(spark, snapshot), parts(spark, snapshot)
    void = bool(seen - there)
    new = there if void else there - seen
    if not new and not void:
        return set()
    number = now[0].number + 1 if now else 0
    merge = not void and len(now) + 1 >= MERGE_EVERY
    rows = _new_lines(spark, ledger, new, schema) if new else condensed(spark.createDataFrame([], schema))
    for part in _sums(spark, snapshot, now, rows.schema) if merge else []:
        rows = rows.unionByName(part)
    place = f"{snapshot}/part={number}"
    (condensed(rows) if merge else rows).write.mode("overwrite").parquet(f"{place}/sums")
    names = sorted(new | seen if merge else new)
    spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(f"{place}/files")
    fs, mark = _at(spark, f"{snapshot}/done/part_{number}_{0 if merge or void else number}")
    fs.create(mark, True).close()
    if merge or void:
        for old in now:
            for path in (f"{snapshot}/done/part_{old.number}_{old.first}", f"{snapshot}/part={old.number}"):
                fs.delete(_at(spark, path)[1], True)
    return new


def snapshot_ledger(spark: SparkSession, ledger: str, snapshot: str, schema) -> DataFrame:
    """The ledger, condensed: from its snapshot and from the files that came after it."""
    there, seen = ledger_files(spark, ledger), seen_files(spark, snapshot)
    if seen - there:
        return _new_lines(spark, ledger, there, schema) if there else condensed(spark.createDataFrame([], schema))
    rows = condensed(spark.createDataFrame([], schema)) if there == seen else _new_lines(spark, ledger, there - seen, schema)
    for part in _sums(spark, snapshot, parts(spark, snapshot), rows.schema):
        rows = rows.unionByName(part)
    return rows

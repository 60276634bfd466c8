"""Exact top-k inner products by a three-phase uniform threshold.

The components of the vectors are cut into ``SLICES`` slices; within a slice, every query has a list of candidates by
partial score. (1) Each block of candidates sends the ``k`` best of every list, with the whole scores of these entries.
(2) The ``k``-th best whole score gathered for a query is a safe cutoff: a candidate that reaches it must reach its
share, cutoff / SLICES, in at least one slice. The cutoffs go back to the blocks, which collect the entries that reach
the share in some slice. (3) The whole scores of these are worked out exactly, and the best ``k`` at or above the cutoff
are left. Nothing is approximate at any step.

Queries meet all rows in blocks: candidates are packed into matrices where they lie, blocks of queries are sent to
each group of candidate blocks, and a task multiplies one pair of matrices at a time. Every block returns at most
``k`` entries for each query and list, so a vector that stands in a third of the rows sends no more than others.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
every row is a candidate, those of a repeated id too, but for rows of the query's own id; a query id that stands on
several rows has one list, of the best pairs of any of them; vectors of different lengths are compared as if the
shorter one went on with zeros; other columns are left out; an empty table, or one without queries, gives an empty
result. Scores beyond a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.shared import written

K = 10
SLICES = 2
ROWS = 4096
QUERIES = 512
# Blocks of candidates that a block of queries meets in one group.
BLOCKS = 64
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
        .select(F.col(key).cast("long").alias("vec_id"),
                F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    )


def matrices(vectors: DataFrame, size: int, cutoff: bool = False) -> DataFrame:
    """Rows packed, where they lie, into matrices of up to ``size`` rows in order of the id."""
    columns = ["vec_id", "v", *(["cutoff"] if cutoff else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                lists = part.column("v")
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                width = int(lengths.max(initial=0))
                m = np.zeros((len(lengths), width), dtype=np.int64)
                m[np.arange(width) < lengths[:, None]] = values
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                order = np.argsort(ids)
                cuts = b""
                if cutoff:
                    # Where too few entries were gathered there is no cutoff.
                    c = part.column("cutoff")
                    known = c.is_valid().to_numpy(zero_copy_only=False)
                    cuts = np.where(known, c.fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min)[order]
                    cuts = cuts.tobytes()
                small = m if width and np.abs(m).max(initial=0) >= 1 << 31 else m.astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([ids[order].tobytes()]), pa.array([small[order].tobytes()]),
                    pa.array([width]), pa.array([small.dtype.itemsize]), pa.array([cuts])],
                    ["block", "ids", "m", "width", "item", "cuts"])
                number += 1

    return vectors.select(*columns).mapInArrow(
        pack, "block long, ids binary, m binary, width long, item long, cuts binary")


def pairs(candidates: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """Each block of candidates with each block of queries."""
    names = ["ids", "m", "width", "item"]
    left = candidates.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), *names)
    right = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
        *[F.col(c).alias(f"q_{c}") for c in [*names, "cuts"]])
    # The right side of a join is held for a key: the group's candidates, of which there is a fixed number.
    return right.repartition(groups, "group").join(left.repartition(groups, "group"), "group").drop("group")


def _matrix(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], dtype=np.int64)
    kind = np.int32 if row[f"{prefix}item"] == 4 else np.int64
    return ids, np.frombuffer(row[f"{prefix}m"], dtype=kind).reshape(len(ids), row[f"{prefix}width"])


def partial_scores(c: np.ndarray, q: np.ndarray, slices: int) -> list[np.ndarray]:
    """For each slice, the inner products of every candidate and query, exactly."""
    width = min(c.shape[1], q.shape[1])
    c, q = c[:, :width], q[:, :width]
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1)
    if most >= 2**62:
        raise ValueError("scores beyond a long")
    # Products of doubles are exact below 2**53.
    kind = np.float64 if most < 2**53 else np.int64
    edges = np.linspace(0, width, slices + 1).astype(int)
    return [(c[:, a:b].astype(kind) @ q[:, a:b].T.astype(kind)).astype(np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True)]


def best(row: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of each query, ties to the smaller row."""
    order = np.lexsort((row, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
    return order[rank < k]


def _found(rows, queries, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (queries, rows, scores)], schema=FOUND)


def gather(k: int, slices: int):
    """Phase 1: the best ``k`` of each list of a block, with whole scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, c), (q_ids, q) = _matrix(row), _matrix(row, "q_")
                lists = partial_scores(c, q, slices)
                own = ids[:, None] == q_ids
                total = sum(lists)
                keep = np.zeros(total.shape, dtype=bool)
                for s in lists:
                    s[own] = np.iinfo(np.int64).min
                    cut = np.partition(s, max(len(s) - k, 0), axis=0)[max(len(s) - k, 0)]
                    r, j = np.nonzero((s >= cut) & ~own)
                    at = best(r, j, s[r, j], k)
                    keep[r[at], j[at]] = True
                r, j = np.nonzero(keep)
                yield _found(ids[r], q_ids[j], total[r, j])

    return run


def resolve(k: int, slices: int):
    """Phases 2 and 3: entries that reach their share of the cutoff in some slice, their whole scores, the best ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, c), (q_ids, q) = _matrix(row), _matrix(row, "q_")
                cuts = np.frombuffer(row["q_cuts"], dtype=np.int64)
                # The least whole number at or above the share; the smallest long stands for no cutoff.
                share = np.where(cuts == np.iinfo(np.int64).min, cuts, -(-cuts // slices))
                lists = partial_scores(c, q, slices)
                enough = lists[0] >= share
                for s in lists[1:]:
                    enough |= s >= share
                r, j = np.nonzero(enough & (ids[:, None] != q_ids))
                total = sum(s[r, j] for s in lists)
                above = total >= cuts[j]
                r, j, total = r[above], j[above], total[above]
                at = best(r, j, total, k)
                yield _found(ids[r[at]], q_ids[j[at]], total[at])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's best other vectors."""
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    queries = vectors.where(is_query)
    rows, asked = vectors.count(), queries.count()
    width = max(1, -(-asked // QUERIES))
    # As many as tasks while there are few rows; beyond that a group stays as large as it is.
    blocks = -(-rows // ROWS)
    groups = max(1, -(-blocks // BLOCKS), min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    candidates = matrices(vectors, ROWS)
    dealt = lambda df: df.repartition(width, "vec_id")
    form = "query_id long, vec_id long, score long"
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    first = pairs(candidates, matrices(dealt(queries), QUERIES), groups).mapInArrow(gather(k, slices), form)
    cutoffs = (
        first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        .select(F.col("query_id").alias("vec_id"), F.when(F.col("n") == k, F.col("least")).alias("cutoff"))
    )
    cut = queries.join(cutoffs, "vec_id", "left")
    last = pairs(candidates, matrices(dealt(cut), QUERIES, cutoff=True), groups).mapInArrow(resolve(k, slices), form)
    return (
        last.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

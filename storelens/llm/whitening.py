"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers (``SCALE`` times the entry, rounded down). The fit list holds each distinct vector once;
its length n and sums S give the mean. Vectors are centred before they are multiplied: tasks subtract the whole number
nearest to the mean, so that products of what is left are exact, sum the products of a batch as one matrix product and
send one row of sums for each dimension. What the rounding of the mean leaves, less than one half, is taken off the
sums at the end. The scatter, dimensions times dimensions and not a row more, goes to the driver; ``MOST_DIMENSIONS``
bounds it.

There the scatter is factored as P L L' P' with the largest remaining diagonal entry as pivot, which shows its rank, and
the columns of P L are rotated in pairs until all are at right angles. The squared norm of a column is an eigenvalue of
the scatter and the column made a unit its eigenvector, both without ever forming a product of the factor with itself.

Defined results: rows whose vector is null, empty or holds null, NaN or an infinity, or an entry beyond ``LARGEST``
after scaling, take no part; nor do those of another length than the commonest one (of equally common lengths the longest). Rows without an id and
repeated rows come out as they went in; other columns are left out. Components without variance are not returned, so
vectors that are all the same, or one alone, give no rows, and neither does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import written

SCALE = 256
# Whole numbers up to here, and their differences, are exact as doubles.
LARGEST = 2.0**50
# Components whose share of the variance is below what doubles can tell from nothing.
NOTHING = 1e-14
MOST_DIMENSIONS = 8192
# Vectors multiplied at once in a task.
BLOCK = 4096
SWEEPS = 60


def scaled(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows that take part, all of one length."""
    entry = lambda c: F.floor(c.cast("double") * scale)
    good = lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) <= LARGEST)  # noqa: E731  (NaN is the largest)
    fine = rows.where(F.coalesce(F.forall(vector, good), F.lit(False)) & (F.size(vector) > 0)).select(
        F.col(key).alias("vec_id"), F.transform(vector, entry).alias("x"))
    sizes = fine.groupBy(F.size("x").alias("dimensions")).count().orderBy(F.desc("count"), F.desc("dimensions")).first()
    dimensions = sizes["dimensions"] if sizes else 0
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} entries; at most {MOST_DIMENSIONS} are supported")
    return fine.where(F.size("x") == dimensions)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.slice(at, BLOCK))
                sums = x.sum(axis=0).astype(object)
                n, total = n + len(x), sums if total is None else total + sums
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), type=pa.int32()), pa.array([n] * len(total), type=pa.int64()),
                 pa.array(total.tolist(), type=pa.decimal128(38, 0))], ["i", "n", "s"])

    rows = fit.select("x").mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def scatter(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sums of products of the centred vectors of a list of ``n`` with these sums."""
    near = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    d = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = (_matrix(batch.slice(at, BLOCK)) - near).astype(np.float64)
                total += z.T @ z
        # One row of the matrix at a time; a list of its entries keeps rows few.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), type=pa.list_(pa.float64()))], ["i", "row"])

    parts = fit.select("x").mapInArrow(products, "i int, row array<double>")
    entries = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in entries.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).toLocalIterator():
        out[r["i"]] = [e["v"] for e in r["row"]]
    # The mean lies this far from the whole number that was subtracted; exact, then rounded once.
    left = np.array([(s - n * int(c)) / n for s, c in zip(sums, near.tolist(), strict=True)])
    return out - n * np.outer(left, left)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """A factor G of as many columns as ``a`` has rank, G G' = ``a``: lower triangular once its rows are sorted by pivot."""
    d = len(a)
    left = np.array(np.diag(a))
    small = NOTHING * max(left.max(initial=0.0), 0.0)
    g = np.zeros((d, d))
    done = np.zeros(d, dtype=bool)
    for k in range(d):
        pivot = int(np.argmax(np.where(done, -np.inf, left)))
        if left[pivot] <= small:
            return g[:, :k]
        column = (a[:, pivot] - g[:, :k] @ g[pivot, :k]) / np.sqrt(left[pivot])
        column[done] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        g[:, k] = column
        done[pivot] = True
        left = left - column**2
    return g


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``n`` columns once, in rounds of pairs that share no column."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if a < n and b < n]
        out.append(tuple(np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else None)
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return [r for r in out if r]


def one_sided_jacobi(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of G G', by falling eigenvalue: columns of ``g`` are rotated in
    pairs until all are at right angles."""
    g = g.copy()
    rounds = rounds_of_pairs(g.shape[1])
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), scale, out=np.zeros_like(xy), where=scale > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-17
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
        if worst < 1e-15:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, g = values[order], g[:, order]
    return values, np.divide(g, np.sqrt(values), out=np.zeros_like(g), where=values > 0)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive, so that two runs agree."""
    at = np.argmax(np.abs(vectors), axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


class Whitening:
    """What a fit list gives: ``n`` vectors, exact ``sums``, eigenvalues ``e`` of the covariance with their unit
    ``components`` as columns, and the ``trace`` of the covariance."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray) -> None:
        self.n, self.sums = n, sums
        covariance = products / n
        self.trace = float(np.trace(covariance))
        values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
        real = values > NOTHING * self.trace
        self.e, self.components = values[real], _signed(vectors[:, real])


def fitted(fit: DataFrame) -> Whitening | None:
    """The whitening of a list of distinct vectors (x); None if it is empty."""
    n, sums = _sums(fit)
    return Whitening(n, sums, scatter(fit, n, sums)) if n else None


def projected(rows: DataFrame, model: Whitening, most: int) -> DataFrame:
    """(vec_id, deviation, whitened): each row's values on the first components, and its exact squared distance from
    the mean in units of 1/n, null where it doesn't fit 38 digits."""
    k = min(most, len(model.e))
    n, sums = model.n, model.sums
    # The mean in two parts: a whole number that is subtracted exactly, and what is left.
    near = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = [s - n * c for s, c in zip(sums, near.tolist(), strict=True)]
    left = np.array([r / n for r in rest])
    onto = model.components[:, :k] / np.sqrt(model.e[:k])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_of_rest = max((abs(r) for r in rest), default=0)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                z = _matrix(part) - near
                # Summed row by row, so that equal rows have equal values wherever they stand.
                values = np.stack([((z - left) * onto[:, c]).sum(axis=1) for c in range(k)], axis=1)
                # n z - rest, squared and summed in whole numbers; Python's own where 64 bits might not hold them.
                largest = int(np.abs(z).max(initial=0)) * n + most_of_rest
                if largest * largest * len(rest) < 2**63:
                    own = ((z * n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    own = ((z.astype(object) * n - np.array(rest, dtype=object)) ** 2).sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([o if o < 10**38 else None for o in own], type=pa.decimal128(38, 0)),
                     pa.array(list(values), type=pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(
        project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(fit: DataFrame, model: Whitening, most: int) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity."""
    k = min(most, len(model.e))
    values = projected(fit.select(F.lit(0).alias("vec_id"), "x"), model, most)
    at = lambda i: F.element_at("whitened", i + 1)
    means = values.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = values.agg(*[F.avg((at(i) - means[i]) * (at(j) - means[j])) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))


def whitened(rows: DataFrame, most: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row's value on up to ``most``
    components, with the component's share of the variance."""
    own = written(scaled(rows, key, vector), "whitening-rows")
    fit = written(own.select("x").distinct(), "whitening-fit")
    model = fitted(fit)
    schema = (f"vec_id {own.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), "
              "whitened double, explained double, identity_error double")
    if model is None or not len(model.e):
        return rows.sparkSession.createDataFrame([], schema)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.e[:most]])
    error = identity_error(fit, model, most)
    return projected(own, model, most).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))

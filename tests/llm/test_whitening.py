import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import whitening
from storelens.llm.registered import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, x int, component int, n long"


def table(spark, vectors, ids=None):
    ids = ids or range(len(vectors))
    return spark.createDataFrame([(i, v, 7, 8, 9, 10) for i, v in zip(ids, vectors, strict=True)], VECTORS)


def plainly(vectors):
    """Distinct whole-number vectors and, from NumPy's own solver, eigenvalues and eigenvectors by falling eigenvalue."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors
         if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted(set(map(tuple, x))), dtype=float)
    centred = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / len(fit))
    return np.array(x), fit, e[::-1], u[:, ::-1]


def same_as_plain(rows, vectors, most=4):
    x, fit, e, u = plainly(vectors)
    n, sums = len(fit), fit.sum(axis=0).astype(int).tolist()
    assert len(rows) == len(x) * most
    for c in range(most):
        mine = sorted((r.vec_id, r.whitened, r.deviation) for r in rows if r.component == c + 1)
        got = np.array([v for _, v, _ in mine])
        want = (x - fit.mean(axis=0)) @ u[:, c] / np.sqrt(e[c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert [int(d) for *_, d in mine] == [sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
        assert {r.n for r in rows} == {n}
        assert all(abs(r.explained - e[c] / e.sum()) < 1e-10 for r in rows if r.component == c + 1)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_as_numpy_solves_it(spark):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(400, 12)) @ draw.normal(size=(12, 12)) + 3).astype(np.float32).tolist()
    vectors += [vectors[0]] * 300 + [vectors[7]] * 3
    rows = whitening.whitened(table(spark, vectors).repartition(5)).collect()
    same_as_plain(rows, vectors)


def test_far_from_the_origin(spark):
    # Without centring first, squares of a million lose the variance of these.
    draw = np.random.default_rng(4)
    vectors = (100_000 + draw.normal(size=(300, 6)) * np.array([5, 4, 3, 2, 1, 0.5])).astype(np.float32).tolist()
    same_as_plain(whitening.whitened(table(spark, vectors)).collect(), vectors)


def test_whole_table_as_registered(spark, data):
    vectors = [r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = QUERIES["op12_pivoted_whitening"](spark, data)
    assert dict(rows.dtypes)["deviation"] == "bigint" and dict(rows.dtypes)["n"] == "bigint"
    same_as_plain(rows.collect(), vectors)


def test_odd_rows(spark):
    draw = np.random.default_rng(5)
    good = draw.normal(size=(40, 3)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [0.5], [3.0e38, 0.0, 0.0]]
    df = table(spark, [*good, *odd, good[0]], [*range(40), *range(100, 108), None])
    rows = whitening.whitened(df, most=4).collect()
    assert {r.component for r in rows} == {1, 2, 3} and len(rows) == 41 * 3
    assert {r.vec_id for r in rows} == {*range(40), None}
    assert [r.whitened for r in rows if r.vec_id is None] == [r.whitened for r in rows if r.vec_id == 0]


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_nothing_to_whiten(spark, vectors):
    out = whitening.whitened(table(spark, vectors))
    assert out.collect() == []
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rank_and_ties(spark):
    # Two dimensions that say the same, one that is constant, and two equal eigenvalues.
    vectors = [[float(a), float(b), float(a), 5.0] for a in (-1, 1) for b in (-math.sqrt(2), math.sqrt(2))]
    rows = whitening.whitened(table(spark, vectors)).collect()
    assert {r.component for r in rows} == {1, 2} and rows[0].identity_error < 1e-9
    alone = whitening.whitened(table(spark, [[0.0], [1.0], [1.0]])).orderBy("vec_id").collect()
    assert [abs(r.whitened) for r in alone] == pytest.approx([1, 1, 1]) and alone[0].explained == 1


def test_long_sums_stay_exact(spark):
    rows = spark.range(3).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 1e12, F.lit(-1e9)).alias("embedding"))
    out = whitening.whitened(rows).collect()
    assert [int(r.deviation) for r in sorted(out)] == [(3 * 256 * 10**12) ** 2, 0, (3 * 256 * 10**12) ** 2]


def test_factor_and_rotations():
    draw = np.random.default_rng(6)
    a = draw.normal(size=(9, 5))
    a = a @ np.diag([1, 1e-2, 1e-4, 1e-5, 1e-6]) @ a.T[:5]
    a = (a + a.T) / 2
    a = a @ a.T
    g = whitening.pivoted_cholesky(a)
    assert np.allclose(g @ g.T, a, rtol=1e-12, atol=1e-14 * a.max())
    e, u = whitening.one_sided_jacobi(g)
    assert np.allclose(u.T @ u, np.eye(g.shape[1]), atol=1e-13) and (np.diff(e) <= 0).all()
    assert np.allclose((u * e) @ u.T, a, atol=1e-13 * a.max())
    for n in (1, 2, 5, 8):
        pairs = sorted((min(p), max(p)) for x, y in whitening.rounds_of_pairs(n) for p in zip(x.tolist(), y.tolist(), strict=True))
        assert pairs == [(i, j) for i in range(n) for j in range(i + 1, n)]

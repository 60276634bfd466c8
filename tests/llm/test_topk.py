import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from storelens.llm import topk
from storelens.llm.registered import SQL

FORM = "vec_id long, embedding array<float>, score int"


def plain(rows, k=10):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in vectors if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, v in vectors if i == q for c, w in vectors if c != q)[:k]
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores, 1)]
    return sorted(out)


def found(df, **args):
    return sorted(tuple(r) for r in topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 100 == 0, **args).collect())


@pytest.mark.parametrize("rows, queries, slices", [(4096, 512, 2), (37, 2, 2), (37, 3, 4)])
def test_against_plain_version(spark, monkeypatch, rows, queries, slices):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", queries)
    draw = random.Random(9)
    data = [(i, [round(draw.gauss(0, 0.2), 2) for _ in range(8)], 0) for i in range(700)]
    same = [0.5] * 8
    data += [(i, same, 0) for i in range(700, 1000)]  # ties without end
    data += [(1000, same, 0), (1001, None, 0), (1002, [1.0, None], 0), (1003, [float("nan")] * 8, 0), (1004, [float("inf")] * 8, 0),
             (None, same, 0), (1100, [], 0), (1200, [9.0], 0), (5, same, 0), (5, same, 0), (100, [-0.25] * 8, 0)]
    assert found(spark.createDataFrame(data, FORM), slices=slices) == plain(data)


def test_few_rows_and_none(spark):
    data = [(0, [1.0, 2.0], 1), (1, [0.5, 0.5], 1)]
    assert found(spark.createDataFrame(data, FORM)) == plain(data) == [(0, 1, 1, 1536 * 1024)]
    assert found(spark.createDataFrame([], FORM)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1)], FORM)) == []


@pytest.mark.parametrize("blocks", [64, 1])
def test_repeated_ids_as_in_the_registered_sql(spark, tmp_path, monkeypatch, blocks):
    """Rows of one id are candidates each; in groups of one block, more groups than shuffle partitions."""
    monkeypatch.setattr(topk, "ROWS", 4)
    monkeypatch.setattr(topk, "BLOCKS", blocks)
    draw = random.Random(4)
    data = [(i % 150, [round(draw.gauss(0, 0.2), 2) for _ in range(4)], 0) for i in range(300)]
    data += [(7, [0.9] * 4, 0)] * 12 + [(100, [0.9] * 4, 0)] * 2
    df = spark.createDataFrame(data, FORM)
    df.write.parquet(str(tmp_path / "embeddings"))
    with duckdb.connect() as con:
        con.sql(f"create view embeddings as from read_parquet('{tmp_path}/embeddings/*.parquet')")
        want = sorted(con.sql(SQL["op5_uniform_threshold_top_k"]).fetchall())
    assert found(df) == plain(data) == want

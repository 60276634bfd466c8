import collections
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelens.llm import kneser_ney
from storelens.llm.quality import remainder
from tests.llm.conftest import plain_words, prose


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.count, self.pairs = collections.Counter(), collections.Counter()
        for t in texts:
            words = [*plain_words(t), None]
            self.count.update(words)
            self.pairs.update(zip(["<s>", *words], words))
        self.n, self.v = self.count.total(), len(self.count)
        self.before = collections.Counter(w for _, w in self.pairs)
        ns = lambda c: np.array([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
        self.d, self.own = (0, *kneser_ney.discounts(ns(self.pairs))), (0, *kneser_ney.discounts(ns(self.before)))
        self.rest = sum(self.own[min(x, 3)] for x in self.before.values()) / len(self.pairs)
        self.total, self.left = collections.Counter(), collections.Counter()
        for (u, _), c in self.pairs.items():
            self.total[u] += c
            self.left[u] += self.d[min(c, 3)]

    def p(self, u, w):
        k = self.before.get(w, 0)
        single = (k - self.own[min(k, 3)]) / len(self.pairs) + self.rest / (self.v + 1)
        if not self.total.get(u):
            return single
        c = self.pairs.get((u, w), 0)
        return (c - self.d[min(c, 3)]) / self.total[u] + self.left[u] / self.total[u] * single

    def scores(self, text):
        words = [*plain_words(text), None]
        return (len(words), sum(w in self.count for w in words),
                sum(math.log10((self.count.get(w, 0) + 1) / (self.n + self.v + 1)) for w in words),
                sum(math.log10(self.p(u, w)) for u, w in zip(["<s>", *words], words)))


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_version(spark, awkward, monkeypatch, small):
    if small:
        monkeypatch.setattr(kneser_ney, "HELD", 50)
    texts = [prose(i % 50, 30 + i, vocabulary=6) for i in range(80)]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    docs = docs.unionByName(awkward.where("coalesce(doc_id, 0) <> 6").select("doc_id", "text"))
    rows = docs.collect()
    plain = Plain([r.text for r in rows if not held(r.doc_id)])
    out = kneser_ney.language_model(docs.withColumn("score", F.lit("clash")), remainder("doc_id", 7) == 2).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        want = plain.scores(text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[:2], plain.n)
        assert abs(r.base_score - want[2]) < 1e-8 and abs(r.score - want[3]) < 1e-8
    # Probabilities after a word, with one for unknown words, sum to one.
    for u in ["<s>", plain_words(texts[0])[0], "never seen"]:
        assert abs(sum(plain.p(u, w) for w in plain.count) + plain.p(u, "never seen") - 1) < 1e-9


def test_nothing_to_learn_from(spark, nothing):
    assert kneser_ney.language_model(nothing, F.lit(False)).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = kneser_ney.language_model(docs, F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in out) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_hashes_of_pairs_are_undone():
    draw = np.random.default_rng(1)
    u, w = draw.integers(0, 2**31, 1000), draw.integers(0, 2**32, 1000)
    a, b = kneser_ney.unpaired(kneser_ney.pair_keys(u, w))
    assert (a == u).all() and (b == w).all()


def test_counts_beyond_32_bits():
    large = np.array([5_000_000_000, 1, 6_000_000_000], dtype=np.int64)
    for counts in (large, large[1:2], large[:0], np.array([2**32 - 1, 0], dtype=np.int64), np.array([2**32], dtype=np.int64)):
        packed = kneser_ney.narrow(counts).tobytes()
        assert (kneser_ney.widened(packed, len(counts)) == counts).all()
    # The totals of a word meet from several buckets.
    ids = np.array([0, 3, 9])
    sums = np.stack([large, large * 0, large * 0, large], axis=1)
    found = {}
    for blob in kneser_ney._stretches(ids, sums, 4, 4, b"u"):
        for r in blob.to_pylist():
            at = np.cumsum(np.frombuffer(r["a"], dtype=np.uint32), dtype=np.int64) + 4 * r["bucket"]
            found |= dict(zip(at.tolist(), kneser_ney.widened(r["b"], 4 * len(at)).reshape(-1, 4)[:, 0].tolist()))
    assert found == dict(zip(ids.tolist(), large.tolist()))


def test_large_counts_in_the_arrays(spark, tmp_path, monkeypatch):
    """Every occurrence stands for 3 * 10^9 of them: sums, files and lookups hold such counts."""
    many = 3_000_000_000
    plain_sum = kneser_ney.summed
    # Only counts of single occurrences, which come as ones, are multiplied.
    monkeypatch.setattr(kneser_ney, "summed", lambda k, c: plain_sum(k, np.where(c == 1, many, c)))
    monkeypatch.setattr(kneser_ney, "mounted", lambda spark: str(tmp_path))
    texts = ["a b a b", "a b", "c"]

    class Rows:
        """A table of one task, run here so that the replaced sum is seen."""

        def __init__(self, batches):
            self.batches = list(batches)

        def mapInArrow(self, f, _):
            return Rows(f(iter(self.batches)))

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, key):
            rows = [r for b in self.batches for r in b.to_pylist()]
            return Rows([pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r[key]), schema=self.batches[0].schema)])

        def select(self, *_):
            return self

        def collect(self):
            return [r for b in self.batches for r in b.to_pylist()]

    rows = Rows([pa.RecordBatch.from_pydict({"text": texts})])
    layout = kneser_ney.count_pairs(rows, kneser_ney.count_words(rows, str(tmp_path), 1))
    before = len(os.listdir("/proc/self/fd"))
    model = kneser_ney.Model(layout)
    assert len(os.listdir("/proc/self/fd")) == before  # however many arrays there are
    hashes, _ = kneser_ney.tokens([b"a b c"])
    ids, counts = model.words.find(hashes)
    assert counts.tolist() == [3 * many, 3 * many, many, 3 * many]
    assert model.pair_counts(ids[:1], ids[1:2]).tolist() == [3 * many]
    assert model.stat("total", ids[:3]).tolist() == [3 * many, 3 * many, many]
    assert layout.n == 10 * many


def test_more_words_than_numbers_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MOST_WORDS", 3)
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    with pytest.raises(ValueError, match="distinct words"):
        kneser_ney.language_model(docs, F.lit(False))

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from storelens.llm import spelling
from storelens.llm.registered import QUERIES
from tests.llm.conftest import DOCS


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def neighbours(word, alphabet):
    cuts = range(len(word) + 1)
    out = {word[:i] + word[i + 1 :] for i in cuts[:-1]}
    out |= {word[:i] + c + word[i + k :] for i in cuts for c in alphabet for k in (0, 1)}
    return out - {word}


def plain_variants(counts):
    """Every possible word one letter away, looked up."""
    alphabet = {c for w in counts for c in w}
    near = {w: [x for x in neighbours(w, alphabet) if x in counts] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_as_brute_force_on_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, data).collect()]
    assert len(got) == len(set(got)) > 500 and set(got) == plain_variants(plain_counts(rows))
    assert sum(g[1] is not None for g in got) > 10


@pytest.mark.parametrize(("letters", "node_words"), [("abcdefghijklmnoprstuéßÉÿ", 20_000), ("ab", 20_000), ("abc", 40), ("abé", 3)])
def test_crowded_words_as_brute_force(spark, monkeypatch, letters, node_words):
    # Few letters make words of the same vector and near each other; small parts deal subtries out by halves.
    monkeypatch.setattr(spelling, "NODE_WORDS", node_words)
    draw = random.Random(len(letters))
    made = ["".join(draw.choice(letters) for _ in range(draw.choice([3, 4, 5, 6, 7, 8, 9]))) for _ in range(500)]
    made += [w[:i] + draw.choice(letters) + w[i + draw.choice([0, 1]) :] for w in made for i in [draw.randrange(len(w))]]
    counts = {w: draw.randrange(3, 60) for w in made if len(w) >= 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = {(w, k, fn, f) for w, f, _, _, k, fn in plain_variants(counts) if k}
    got = {(r.word, r.n_near, r.best_n if r.best_n >= 2 * counts[r.word] else None, r.best if r.best_n >= 2 * counts[r.word] else None)
           for r in spelling.near_words(words).collect()}
    assert got == want


def test_many_words_of_one_vector(monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 2000)
    draw = random.Random(9)
    words = sorted({"".join(draw.sample("aabbccdd", 8)) for _ in range(1500)} | {"".join(draw.sample("aabbccdd", 8))[:7] for _ in range(300)})
    counts = {w: 3 + i % 50 for i, w in enumerate(words)}
    batch = spelling.searched(words, list(counts.values()), [True] * len(words), [-1] * len(words))
    got = {r["word"]: r["n_near"] for r in batch.to_pylist()}
    assert got == {w: k for w, _, _, _, k, _ in plain_variants(counts) if k}


def test_roots_follow_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w7")]
    found = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert set(found.values()) == {"w20"} and len(found) == 21


def test_odd_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.variants(awkward).collect()} == plain_variants(plain_counts(rows))
    out = spelling.variants(nothing)
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_very_long_words(spark):
    long = "ab" * 60_000
    texts = [long, long, long, long[:-1] + "c", long[:-1] + "c", long[:-1] + "c", "x" + long, "x" + long, "x" + long, "short " * 3]
    docs = spark.createDataFrame([(None, t, "en", "a", 1) for t in texts], DOCS)
    got = {len(r.word): r.n_near for r in spelling.variants(docs).collect() if r.word != long[:-1] + "c"}
    assert got == {120_000: 2, 120_001: 1, 5: 0}


def test_vectors_keep_the_budget():
    draw = random.Random(2)
    for _ in range(300):
        w = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randrange(5, 40)))
        i = draw.randrange(len(w))
        other = w[:i] + draw.choice("aqé") * draw.randrange(2) + w[i + draw.randrange(2) :]
        if other == w:
            continue
        a, b = spelling.Described([w, other]).counts.astype(int)
        assert np.maximum(a - b, 0).sum() <= 1 and np.maximum(b - a, 0).sum() <= 1
        first, last = spelling.with_equal_half(spelling.Described([w]), np.array([0]), spelling.Described([other]), np.array([0]))
        assert first[0] or last[0]
        assert spelling.one_apart(w, other)

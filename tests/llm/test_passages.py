import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import passages
from storelens.llm.shared import laid_by
from tests.llm.conftest import plain_words, prose


def test_compact_windows_against_plain_version():
    draw = np.random.default_rng(1)
    for _ in range(200):
        width = int(draw.integers(1, 6))
        texts = [draw.integers(5, 5 + draw.integers(2, 30), draw.integers(0, 25)) for _ in range(4)]
        values, first, last = [], [], []
        for t in texts:
            first.append(len(values))
            last.append(len(values) + len(t))
            values += [*t.tolist(), *[2**64 - 1] * width]
        v = np.array(values, dtype=np.uint64)
        got = {(int(a), int(b), int(v[c])) for c, a, b in zip(*passages.compact_windows(v, np.array(first), np.array(last), width))}
        want = set()
        for f, l in zip(first, last):
            for c in range(f, l):
                a = b = c
                while a > f and v[a - 1] >= v[c]:
                    a -= 1
                while b < l - 1 and v[b + 1] >= v[c]:
                    b += 1
                if b - a + 1 >= width:
                    want.add((a, b, int(v[c])))
        assert got == want


def corpus():
    draw = random.Random(8)
    shared = [prose(900 + k, 55 + 7 * k) for k in range(4)]
    texts = [prose(i, 40 + i % 90) for i in range(60)]
    for k, i in enumerate(range(10, 50)):
        words = shared[k % 4].split()
        if k % 5 == 0:
            words[27] = "changed"  # a near copy
        texts[i] += " " + " ".join(words) + " " + prose(3000 + i, draw.randrange(60))
    texts += [texts[59]] * 3 + ["again " * 400, "again " * 300, prose(900, 49)]
    return texts


@pytest.mark.parametrize("held", [500_000, 50])
def test_repeats_against_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr(passages, "HELD", held)
    texts = corpus()
    words = [plain_words(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = passages.repeated_passages(docs).collect()
    seen, need = {}, {}
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), d) != d:
                need.setdefault(d, set()).update(range(i, i + 50))
    got = {}
    for r in rows:
        assert r.kept_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        a = words[r.doc_id][r.start_word : r.end_word]
        b = words[r.kept_doc_id][r.kept_start : r.kept_start + len(a)]
        assert sum(x == y for x, y in zip(a, b)) >= 0.9 * len(a)
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert need.keys() <= got.keys()
    missed = sum(len(s - got[d]) for d, s in need.items())
    assert missed <= 0.01 * sum(map(len, need.values()))
    # The near copies, which hold no fifty words of another text, too.
    assert {d for d in range(10, 50) if d > 13} <= got.keys()


def test_cutting_keeps_every_document_and_one_copy(spark):
    texts = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    out = {r.doc_id: r for r in passages.without_repeats(docs).collect()}
    assert len(out) == len(texts) and out[60].text == out[61].text == out[62].text == ""
    assert all(r.n_chars == len(r.text) and r.lang == "en" for r in out.values())
    assert all(out[d].text == texts[d] for d in range(10))
    everything = " ".join(" ".join(out[d].text.split()) for d in sorted(out))
    assert all(prose(900 + k, 55 + 7 * k).split()[5] in everything for k in range(4))
    left = passages.repeated_passages(spark.createDataFrame(list(out.values()), docs.schema)).collect()
    assert left == []


def test_awkward_rows(awkward, nothing):
    rows = passages.repeated_passages(awkward).collect()
    assert {(r.doc_id, r.kept_doc_id, r.start_word, r.end_word) for r in rows} == {(8, 7, 0, 90)}
    assert passages.repeated_passages(nothing).collect() == []
    out = passages.without_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.where(F.col("doc_id") == 8).first().text == "" and out.where("doc_id = 0").first().text is None
    assert passages.without_repeats(nothing).collect() == []


def test_one_changed_word_at_every_place(spark):
    base = [prose(5000 + k, 50).split() for k in range(50)]
    texts = [prose(6000 + k, 20) + " " + " ".join(w) for k, w in enumerate(base)]
    for k, w in enumerate(base):
        texts.append(prose(7000 + k, 30) + " " + " ".join([*w[:k], "changed", *w[k + 1 :]]) + " " + prose(8000 + k, 25))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.kept_doc_id) for r in passages.repeated_passages(docs).collect()}
    # Beside a changed word among the first or last five no shingle is left, and fewer than fifty words repeat.
    assert got == {(50 + k, k) for k in range(5, 45)}


def test_words_put_in_and_left_out(spark):
    base = [prose(5000 + k, 52 + 2 * (k % 24)).split() for k in range(72)]
    texts = [prose(6000 + k, 20) + " " + " ".join(w) for k, w in enumerate(base)]
    need = {}
    for k, w in enumerate(base):
        cut = [len(w) // 2, 10, len(w) - 12][k // 24]
        copy = [*w[:cut], "new", *w[cut:]] if k % 4 < 2 else [*w[:cut], *w[cut + 1 :]]
        before = prose(7000 + k, 30).split()
        need[72 + k] = (30, 30 + len(copy))
        texts.append(" ".join([*before, *copy]) + " " + prose(8000 + k, 25))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == {(d, *span) for d, span in need.items()}
    assert all((r.kept_doc_id, r.kept_start) == (r.doc_id - 72, 20) and r.similarity >= 0.8 for r in rows)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_the_smallest_document_of_a_key_need_not_hold_the_passage(spark, parts):
    rows, need = [], set()
    for k in range(20):
        w = prose(9000 + k, 55).split()
        # Some smaller documents hold 45 of its words, each others next to them.
        for part in range(1 + k % 3):
            rows.append((100 * part + k, " ".join([*w[:45], *prose(9100 + 100 * part + k, 40).split()])))
        for d in (600, 700, 800):
            rows.append((d + k, prose(d + 9000 + k, 20) + " " + " ".join(w) + " " + prose(d + 9500 + k, 20)))
        need |= {(700 + k, 20, 75), (800 + k, 20, 75)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect()}
    assert got == need


def test_a_common_line_costs_rows_not_pairs(spark):
    line = prose(1, 32)
    found = {}
    for n in (200, 800):
        docs = spark.createDataFrame([(d, f"{prose(10_000 + d, 60)} {line} {prose(20_000 + d, 60)}") for d in range(n)],
                                     "doc_id long, text string").repartition(4)
        first = passages.links(docs)
        windows = passages.open_windows(docs, first, first.limit(0).selectExpr("doc_id", "low as start_word", "high as end_word"), 50)
        found[n] = windows.count() + passages.late_links(docs, windows, 50).count()
        assert passages.repeated_passages(docs).collect() == []
    assert found[800] <= 4.5 * found[200]


def test_near_copies_among_documents_with_a_common_line(spark):
    """Each text of a group shares a line with all, and a changed copy of it with one other that isn't the smallest."""
    line, rows, need = prose(1, 30), [], set()
    for d in range(120):
        w = f"{prose(30_000 + d % 60, 14)} {line} {prose(40_000 + d % 60, 30)}".split()
        if d >= 60:
            w[60] = "changed"
            need.add((d, d - 60))
        rows.append((d, " ".join([*prose(50_000 + d, 25).split(), *w, *prose(60_000 + d, 25).split()])))
    got = {(r.doc_id, r.kept_doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == need


def test_runs_of_values():
    draw = np.random.default_rng(2)
    values = draw.integers(0, 2**63, 300).astype(np.uint64)
    values[100:160] = values[10:70]
    for width in (1, 2, 3, 46, 47):
        runs = passages.runs_of(values, width)
        assert len(runs) == 300 - width + 1 and (runs[10 : 71 - width] == runs[100 : 161 - width]).all()
        assert len(np.unique(runs)) == len(runs) - (61 - width)


def test_words_hash_alike_in_blocks(monkeypatch):
    from storelens.llm import words

    texts = [prose(1, 300).encode(), b"", b"x" * 700 + b" y " + b"z" * 129, b" a b "]
    whole = words.Words(texts).hashes()
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    assert (words.Words(texts).hashes() == whole).all()


def test_texts_that_repeat_themselves_are_one_link(spark):
    line = prose(1, 12)
    docs = spark.createDataFrame([(d, f"{prose(100 + d, 30)} {(line + ' ') * n} {prose(200 + d, 30)}") for d, n in enumerate([40, 40, 40, 90])],
                                 "doc_id long, text string").repartition(3)
    found = {}
    for r in passages.links(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert {d: len(rows) for d, rows in found.items()}.keys() == {1, 2, 3} and sum(map(len, found.values())) <= 12
    covered = {}
    for r in passages.repeated_passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    # Every word of the repeated lines.
    assert all(set(range(30, 30 + 12 * n)) <= covered[d] for d, n in ((1, 40), (2, 40), (3, 90)))


def test_copies_are_looked_at_once(spark):
    base = prose(1, 200)
    part = " ".join(base.split()[80:120])
    found = {}
    for n in (5, 40):
        # Whole copies, and a larger document with forty words of them, whose windows stay open.
        texts = [base] * n + [f"{prose(2, 60)} {part} {prose(3, 60)}"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        first = passages.links(docs)
        rows = passages.open_windows(docs, first, passages.verified(docs, first, 46, 0.8), 50).collect()
        assert {r.doc_id for r in rows} == {0, n} and any(r.open for r in rows)
        found[n] = len(rows)
    assert found[5] == found[40]


def test_changed_copies_of_copies(spark):
    """Copies are found through the first of them, and text beside a copied passage through its own document."""
    base, own = prose(1, 160).split(), prose(2, 100).split()
    texts = [" ".join(base), " ".join(base), " ".join([*base[60:], *own])]
    within, across = base[90:145], [*base[-30:], *own[:30]]
    for w, to in ((within, {0, 1, 2}), (across, {2})):
        texts.append(" ".join([*prose(10 + len(texts), 30).split(), *w[:27], "changed", *w[28:], *prose(20 + len(texts), 30).split()]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = passages.repeated_passages(docs).collect()
    got = {d: {(r.start_word, r.end_word) for r in rows if r.doc_id == d} for d in range(5)}
    assert got == {0: set(), 1: {(0, 160)}, 2: {(0, 100)}, 3: {(30, 85)}, 4: {(30, 90)}}
    assert {r.kept_doc_id for r in rows if r.doc_id == 3} <= {0, 1, 2} and {r.kept_doc_id for r in rows if r.doc_id == 4} == {2}


def test_texts_move_once(spark):
    docs = spark.createDataFrame([(d, prose(d, 60)) for d in range(50)] + [(3, "again")], "doc_id long, text string")
    only = spark.createDataFrame([(d,) for d in range(0, 50, 2)] + [(3,)], "doc_id long")
    regions = spark.createDataFrame([(d, 4, 9, "x") for d in (2, 3)] + [(2, 50, 80, "y")], "doc_id long, low int, high int, more string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with laid_by(docs, "doc_id", only, "test-texts") as texts:
            assert sorted(texts.collect()) == sorted(r for r in docs.collect() if r.doc_id % 2 == 0 or r.doc_id == 3)
            cut = passages.slices(texts, regions)
            plan = cut._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
            got = sorted((r.doc_id, r.low, r.more, len(r.hashes)) for r in cut.collect())
        assert got == [(2, 4, "x", 24), (2, 50, "y", 24), (3, 4, "x", 0), (3, 4, "x", 24)]
        assert spark.catalog.listTables() == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_longer_text_with_the_same_id(spark):
    rows = [(0, prose(1, 80)), (1, f"{prose(2, 90)} {prose(1, 80)}"), (1, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {len((r.text or "").split()): r.text for r in passages.without_repeats(docs).collect()}
    assert out.keys() == {80, 90, 1} and out[1] == "short" and out[90].strip() == prose(2, 90)

import zlib

import numpy as np

from storelens.llm import quality
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n=400):
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 40 + i % 60)
        if bad:
            text = [text.upper() + "!!", " ".join(w for w in text.split()[:6] for _ in range(15)),
                    text.replace(" ", " | "), text.replace(" ", "$$$ ")][i // 4 % 4]
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, int(not bad), 0, "clash"))
    return rows, marks


def test_learns_from_the_other_folds_alone(spark):
    from tests.llm.conftest import DOCS

    rows, marks = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in quality.quality(docs, spark.createDataFrame(marks, LABELS)).collect()}
    assert len(out) == len(rows)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    right = [out[i].predicted == q for i, q, *_ in marks if held(i)]
    assert np.mean(right) > 0.9
    # Labels of the fold that is held out, and all but the text, are without effect.
    turned = [(i, 1 - q if held(i) else q, 1, "x") for i, q, *_ in marks]
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'t' as source", "0 as n_chars", "'a' as f")
    again = {r.doc_id: r.score for r in quality.quality(other, spark.createDataFrame(turned, LABELS)).collect()}
    assert all(abs(again[i] - out[i].score) < 1e-9 for i in again)


def test_pairs_teach_an_order():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(0, 1, (300, len(quality.FEATURES))), draw.normal(0, 1, (80, len(quality.FEATURES)))
    bad[:, 3] += 2.5
    model = quality.fitted(good, bad)
    wins = (model.scores(good)[:, None] > model.scores(bad)[None, :]).mean()
    assert wins > 0.9


def test_awkward_rows(spark, awkward):
    marks = spark.createDataFrame([(i, int(i > 3), 0, "") for i in range(10)] + [(5, 0, 0, ""), (5, None, 0, "")], LABELS)
    out = quality.quality(awkward, marks).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert not next(r for r in out if r.doc_id is None).held_out


def test_without_labels(spark, awkward, nothing):
    none = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in quality.quality(awkward, none).collect()} == {(0.5, 1)}
    assert quality.quality(nothing, none).collect() == []


def test_features_by_hand():
    f = dict(zip(quality.FEATURES, quality.features([b"", b"AB ab ab | x!\nAB ab ab | x!"])[1]))
    assert f["same_as_last"] == 2 / 10 and f["distinct"] == 4 / 10 and f["top_word"] == 4 / 10
    assert f["distinct_lines"] == 0.5 and f["bars"] == 2 / 27 and abs(f["distinct_runs"] - 5 / 7) < 1e-12

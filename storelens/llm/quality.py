"""Quality scores learnt from preference pairs (Bradley-Terry) and cut at a score quantile.

Each text becomes a row of shape features (``FEATURES``: shares of character kinds, repetition of words, of word runs
and of lines, word lengths); nothing but the text goes in. The features are spread over a piecewise linear basis whose
knots are quantiles of the labelled rows. A document's score is linear in that basis; the probability that document a
is preferred to document b is the logistic function of their score difference, and the weights maximise the
likelihood of pairs of one good and one bad labelled document. The cut lies at the quantile of the labelled scores that
corresponds to the share of bad labels, and a document's result is the probability that it is preferred to one at the
cut.

The pairs are made of at most ``PER_LABEL`` rows of each label (those with the smallest hash of their id), a bound on
what the driver fits; counts of labels and the quantile take in all labelled rows, and features and scores all rows.

Defined results: no text counts as empty; an empty text gets a score from its (zero) features; a document whose labels
contradict each other counts as bad; rows without an id are scored but never learnt from and are not held out; repeated rows come
out as often as they went in; without labels of both kinds every score is 0.5, and so predicted as good; an empty table
gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import written
from storelens.llm.words import SPACED, Words, parts

PER_LABEL = 20_000
PARTNERS = 8
KNOTS = 8
RIDGE = 1e-3
STEPS = 300

FEATURES = [
    "log_words", "mean_length", "longest", "capitals", "digits", "punctuation", "symbols", "bars", "marks", "not_ascii",
    "white", "same_as_last", "distinct", "top_word", "distinct_runs", "short_words", "long_words", "capital_words",
    "ends_marked", "starts_capital", "log_lines", "distinct_lines", "line_length", "letters_repeat", "punctuated",
]
RUN = 4


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values from each place to the next, and how often the most frequent one stands there."""
    n = len(first) - 1
    of = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, of))
    h, d = hashes[order], of[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate((at, [len(h)])))
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(np.float64), top


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    w = Words(texts, SPACED, lower=False)
    data, n = w.data, np.maximum(w.counts, 1)
    at = w.at.copy()
    size = np.maximum(np.diff(at) - 1, 1)
    share = lambda mask: _sums(mask, at) / size
    upper, digit, other = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data >= 128
    letter = upper | ((data >= 97) & (data <= 122)) | other
    white = ~SPACED[data]
    punct = ~(letter | digit | white)
    lengths = w.ends - w.starts
    hashes = w.hashes()
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, dtype=bool)
    same[w.first[:-1][w.counts > 0]] = False
    distinct, top = _distinct(hashes, w.first)
    # Runs of words without those that reach into the next text.
    runs = hashes.copy()
    for k in range(1, min(RUN, len(runs))):
        runs[: len(runs) - k] = runs[: len(runs) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
    whole = np.maximum(w.counts - RUN + 1, 0)
    first_run = np.concatenate(([0], np.cumsum(whole)))
    inside = np.repeat(w.first[:-1], whole) + np.arange(first_run[-1]) - np.repeat(first_run[:-1], whole)
    distinct_runs, _ = _distinct(runs[inside], first_run)
    caps = np.concatenate(([0], np.cumsum(upper)))
    letters = np.concatenate(([0], np.cumsum(letter)))
    caps_in, letters_in = caps[w.ends] - caps[w.starts], letters[w.ends] - letters[w.starts]
    last = data[w.ends - 1] if len(w.ends) else data[:0]
    begin = data[w.starts] if len(w.starts) else data[:0]
    longest = np.zeros(len(texts))
    np.maximum.at(longest, w.text_of_word(), lengths)
    # Lines are words between line feeds.
    line = Words(texts, np.arange(256) != 10, lower=False, between=b"\n")
    lines = np.maximum(line.counts, 1)
    again = (data[1:] == data[:-1]) & letter[1:]
    per_word = lambda mask: _sums(mask, w.first) / n
    columns = [
        np.log1p(w.counts), _sums(lengths, w.first) / n, np.log1p(longest), share(upper), share(digit), share(punct),
        share(np.isin(data, np.frombuffer(b"#$%&*@^~<>{}[]\\=+_", dtype=np.uint8))), share(data == 124),
        share((data == 33) | (data == 63)), share(other), share(white), per_word(same), distinct / n, top / n,
        distinct_runs / np.maximum(whole, 1), per_word(lengths <= 3), per_word(lengths >= 12),
        per_word((caps_in == letters_in) & (letters_in > 1)), per_word((last == 46) | (last == 33) | (last == 63)),
        per_word((begin >= 65) & (begin <= 90)), np.log1p(lines), _distinct(line.hashes(), line.first)[0] / lines,
        np.log1p(size / lines), share(np.concatenate((again, [False]))), per_word(~letter[w.ends - 1]),
    ]
    return np.stack(columns, axis=1)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f): the features of each text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches):
            f = features(texts).astype(np.float32)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"),
                pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * len(FEATURES), pa.array(f.ravel())),
            ], ["doc_id", "f"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(compute, "doc_id long, f array<float>")


class Model:
    """Knots of each feature, weights over the basis and the score of the cut."""

    def __init__(self, knots: np.ndarray, weights: np.ndarray, cut: float = 0.0) -> None:
        self.knots, self.weights, self.cut = knots, weights, cut

    def basis(self, f: np.ndarray) -> np.ndarray:
        """For each feature and interval between knots, the part of the interval that lies below the value."""
        low, high = self.knots[:, :-1], self.knots[:, 1:]
        width = np.where(high > low, high - low, 1)
        return np.clip((f[:, :, None] - low) / width, 0, 1).reshape(len(f), -1)

    def scores(self, f: np.ndarray) -> np.ndarray:
        return self.basis(f) @ self.weights


def fitted(good: np.ndarray, bad: np.ndarray) -> Model:
    """Bradley-Terry weights from pairs of each bad row with PARTNERS good ones (at least one for each good row)."""
    both = np.concatenate((good, bad))
    model = Model(np.quantile(both, np.linspace(0, 1, KNOTS + 1), axis=0).T, np.zeros(0))
    draw = np.random.default_rng(7)
    pairs = max(len(good), len(bad)) * PARTNERS
    g, b = model.basis(good), model.basis(bad)
    left, right = np.arange(pairs) % len(good), draw.permutation(np.arange(pairs) % len(bad))
    w, velocity, scale = np.zeros(g.shape[1]), np.zeros(g.shape[1]), np.zeros(g.shape[1])
    for step in range(1, STEPS + 1):
        lost = 1 / (1 + np.exp(np.clip((g @ w)[left] - (b @ w)[right], -30, 30)))
        grad = RIDGE * w - (np.bincount(left, lost, len(g)) @ g - np.bincount(right, lost, len(b)) @ b) / pairs
        velocity = 0.9 * velocity + 0.1 * grad
        scale = 0.99 * scale + 0.01 * grad**2
        w -= 0.1 * (velocity / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    model.weights = w
    return model


def remainder(key: str, of: int) -> Column:
    """CRC-32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def learnt(rows: DataFrame, labels: DataFrame) -> Model | None:
    """A model from measured rows and (doc_id, quality); none if there are no labels of both kinds."""
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = rows.join(marks, "doc_id")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    sample = [
        np.array([r["f"] for r in known.where(F.col("quality") == q).select("f", F.xxhash64("doc_id").alias("h"))
                  .orderBy("h").limit(PER_LABEL).collect()], dtype=np.float64)
        for q in (1, 0)
    ]
    model = fitted(*sample)
    share = counts[0] / (counts[0] + counts[1])
    score = raw_scores(known.select("doc_id", "f"), model)
    model.cut = score.agg(F.percentile_approx("score", share, 10_000)).first()[0]
    return model


def raw_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of measured rows, as the Bradley-Terry model has it."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(f.reshape(-1, len(FEATURES))))], ["doc_id", "score"])

    return rows.select("doc_id", "f").mapInArrow(compute, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
            folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of ids whose CRC-32 leaves ``held`` modulo ``folds`` are not used."""
    rows = written(measured(docs, key, text), "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = learnt(rows, known.where(remainder("doc_id", folds) != held))
    if model is None:
        scored = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        cut = float(model.cut)
        scored = raw_scores(rows, model).select("doc_id", (1 / (1 + F.exp(F.lit(cut) - F.col("score")))).alias("score"))
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))

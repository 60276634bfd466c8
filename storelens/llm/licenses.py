"""License scan by ordered signature rules.

A text meets only the rules one of whose keywords it holds. Every match is a detection with its interval. A detection
that lies within another one's interval is suppressed if the other has a better priority, or the same priority and a
longer interval (of equal intervals the first rule in order stays). What is left gives the labels of the method, and
the score is the certainty of the best priority left. Base phrases stand outside of this: all their places count, and
their labels always stay.

Defined results: no text counts as empty (no words, no labels, score 0); repeated rows and rows without an id come
out as they went in; other columns are left out; an empty table gives an empty result. Texts of any length are
scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.license_rules import SURE, rules
from storelens.llm.words import ALNUM, Words, parts

# Phrases of whole words and the labels they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.9

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "detections array<struct<label: string, priority: int, start: long, length: long>>"
)


def surviving(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule), those that no other one of at least their standing contains."""
    # Sorted so that a container comes before what it contains; best end so far for each priority.
    order = sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3]))
    furthest: dict[int, int] = {}
    kept = []
    for start, end, priority, rule in order:
        if not any(p <= priority and reach >= end for p, reach in furthest.items()):
            kept.append((start, end, priority, rule))
        furthest[priority] = max(furthest.get(priority, 0), end)
    # An equal interval with a better priority may stand later only in ties of start and end, which the order settles.
    return kept


def scanner(phrases: Mapping[str, str]):
    """A function from rows to rows of SCHEMA; patterns are compiled once for each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = rules()
        keywords = sorted({k for r in signatures for k in r.keywords})
        gap = rb"[^0-9a-z\x80-\xff]+"
        base = [(re.compile(gap.join(map(re.escape, phrase.encode().split()))), phrase.encode().split()[-1], label)
                for phrase, label in phrases.items()]
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
            ("detections", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()),
                                               ("start", pa.int64()), ("length", pa.int64())]))),
        ])
        for rows, texts in parts(batches):
            words = Words(texts, ALNUM)
            data = words.data.tobytes()
            out = []
            for d, (number, count) in enumerate(zip(rows.column("doc_id").to_pylist(), words.counts.tolist(),
                                                    strict=True)):
                low, high = int(words.at[d]), int(words.at[d + 1]) - 1
                text = data[low:high]
                places, labels = [], set()
                for pattern, last, label in base:
                    if last not in text:
                        continue
                    for m in pattern.finditer(text):
                        a, b = m.span()
                        if (a and ALNUM[text[a - 1]]) or (b < len(text) and ALNUM[text[b]]):
                            continue
                        places.append(int(np.searchsorted(words.starts, low + a) - words.first[d]))
                        labels.add(label)
                there = {k for k in keywords if k in text}
                found = []
                if there:
                    for i, r in enumerate(signatures):
                        if not there.isdisjoint(r.keywords):
                            found += [(*m.span(), r.priority, i) for m in r.pattern.finditer(text)]
                out.append((
                    number, count, len(places), min(places, default=None), max(places, default=None), sorted(labels),
                    [{"label": signatures[i].label, "priority": p, "start": a, "length": b - a}
                     for a, b, p, i in surviving(found)],
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, type=f.type) for column, f in zip(zip(*out, strict=True), schema, strict=True)],
                schema=schema)

    return scan


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """One row for each text: word count, places of the phrases and the detections that survive."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(scanner(phrases), SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    """Labels and score of each scanned text."""
    sure = F.element_at(
        F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair]),
        F.array_min(F.transform("detections", lambda d: d["priority"])))
    based = F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(sure, F.lit(0.0)), based).alias("score"),
    )

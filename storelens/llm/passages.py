"""Passages that repeat across documents, by compact windows of min-hashes.

A text is a row of 5-word shingles. A passage of ``MIN_WORDS`` words that counts holds 21 unchanged shingles in a row
(25 words) at least: at most five shingles of 46 are changed, so one of the two halves beside a changed word has 21.
Runs of 15 words are hashed, and all stretches of at least 11 such runs that have the same smallest hash form a compact
window: the smallest one's place and the furthest stretch to both sides over which it stays the smallest. The windows
are the nodes of a Cartesian tree over the hashes; a window is kept if it is wide enough, which leaves about one for
six words, however many stretches there are. Any 25 words that two texts share hold a smallest run that both keep, so
no passage depends on chance.

Windows meet by their smallest run. Within a task, and then for each key, windows are joined to the one of the smallest
document, so a key that stands in many documents sends a row for each task and never makes pairs. ``REACH`` shingles
around the common run are a link; links of a document pair at the same distance are merged. Links are
verified: shingles at the same distance, and at ``STEPS`` distances on both sides of it, are compared one by one, and
runs of equal ones are chained over changed words and over words put in or left out. A chain counts as a repeated
passage if it has ``MIN_WORDS`` words and a Jaccard similarity of ``SIMILARITY``, a changed word being five changed
shingles; it begins and ends with equal shingles.

The smallest document of a key need not be the one that a passage repeats: a line that many documents share leads all of
them to the first that has it. Windows that no verified passage covers stay open, and the stretches of 50 words around them are
looked at as a whole. Every such stretch is a key by itself, so that no repeat of fifty equal words depends on chance. For
near copies, ``HASHES`` further hash functions each give the compact windows of all stretches of 46 shingles with the
same smallest one, and windows of two documents meet by hash function and smallest shingle. Windows at the same distance are joined by their
intervals: a pair of documents is a link where at least ``ENOUGH`` hash functions agree in windows that hold a common stretch, or an equal
stretch stands on both sides. Again all windows of a key are joined to the one of the smallest document, so a common line costs a row for each of
its windows, not one for each pair. Windows that are settled don't look for others but are looked at, unless every stretch around them
is word for word in a passage of a smaller document, which is looked at in their place.

The texts of documents that have a link are laid out by id once; later steps bring their questions to them, so that no text moves
again.

Defined results: no text counts as empty; rows without an id are left out (they can't be named); of rows with the same
id only other documents' repeats are found, not those between the rows; repeats within one document don't count; texts of
any length are taken whole; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.shared import dropped, laid_by, salted_join, written
from storelens.llm.words import FACTOR, SPACED, Words, mixed, parts, shingles

MIN_WORDS = 50
SHINGLE = 5
SIMILARITY = 0.8
# Changed shingles in a row that a passage may hold: two changed words side by side, or near each other.
BRIDGE = 10
# Words that may be put in or left out between two runs of a passage.
STEPS = 5
# Shingles on both sides of a common run that a link takes in: an end without a common run of its own, and a bridge.
REACH = 64
# Shingles on both sides of an agreeing place that hold a passage.
AROUND = 80
# Hash functions for open stretches, and how many have to agree on a pair of documents.
HASHES = 12
ENOUGH = 2
# Windows that a task joins to one another before it sends them.
HELD = 200_000
# Slices of a document that others refer to begin and end at multiples of this.
GRAIN = 64
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)

WINDOW = pa.schema([
    ("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("left", pa.int32()), ("right", pa.int32()),
    ("other", pa.int64()), ("shift", pa.int32()),
])


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Smallest (or largest) of each ``width`` values in a row, by doubling."""
    pick = np.minimum if least else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def compact_windows(values: np.ndarray, first: np.ndarray, last: np.ndarray, width: int):
    """(place, left, right) of the windows of at least ``width`` values, over texts at ``first`` to ``last`` of an
    array in which at least ``width`` places lie between two texts."""
    if len(values) < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    least = sliding(values, width)
    # Windows that lie within a text; the smallest value of others doesn't count.
    edge = np.zeros(len(values) + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.maximum(last - width + 1, first), -1)
    inside = np.cumsum(edge)[: len(least)] > 0
    least = np.where(inside, least, np.uint64(0))
    padded = np.concatenate((np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)))
    covering = sliding(padded, width, least=False)
    some = np.zeros(len(values), dtype=bool)
    some[: len(inside)] = inside
    reach = np.cumsum(np.concatenate(([0], some)))
    index = np.arange(len(values))
    covered = reach[index + 1] > reach[np.maximum(index - width + 1, 0)]
    at = np.flatnonzero((covering == values) & covered)
    text = np.searchsorted(first, at, side="right") - 1
    # Nodes of the Cartesian tree: the nearest smaller values on both sides are themselves such places.
    places, lefts, rights = [], [], []
    stack: list[tuple[int, int, int]] = []
    now, begin, end = -1, 0, 0

    def close(upto: int, value: int) -> None:
        while stack and stack[-1][0] > value:
            _, place, left = stack.pop()
            places.append(place)
            lefts.append(left)
            rights.append(upto)

    for place, value, t in zip(at.tolist(), values[at].tolist(), text.tolist(), strict=True):
        if t != now:
            close(end, -1)
            now, begin, end = t, int(first[t]), int(last[t]) - 1
        close(place - 1, value)
        left = stack[-1] if stack else None
        if left and left[0] == value:
            # The same window at another place; of equal values in a row, the first.
            if values[place - 1] != value:
                stack.append((value, place, left[2]))
            continue
        # A smaller value on the stack bounds the window; its last place is the latest pushed or merged one.
        stack.append((value, place, begin if left is None else nearest(values, left[0], left[1], place)))
    close(end, -1)
    return np.array(places, dtype=np.int64), np.array(lefts, dtype=np.int64), np.array(rights, dtype=np.int64)


def nearest(values: np.ndarray, value: int, low: int, place: int) -> int:
    """The place after the last one before ``place`` that holds ``value``, which stands at ``low``."""
    again = np.flatnonzero(values[low + 1 : place] == np.uint64(value))
    return low + 1 if not len(again) else low + 2 + int(again[-1])


def laid_out(texts: list[bytes], gap: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``size`` words of the texts with ``gap`` places between two, and where each text's begin and end."""
    words = Words(texts, SPACED)
    every = shingles(words.hashes(), size)
    counts = np.maximum(words.counts - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts + gap)))[:-1]
    out = np.full(int((counts + gap).sum()), LARGEST, dtype=np.uint64)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    out[np.repeat(first, counts) + inner] = every[np.repeat(words.first[:-1], counts) + inner]
    return out, first, first + counts


def seed(min_words: int) -> tuple[int, int]:
    """(words of a run, runs of a window): any unchanged stretch that a passage must hold has a whole window."""
    half = max(1, (min_words - 2 * SHINGLE + 2) // 2)
    return half // 2 + SHINGLE, half - half // 2


def keyed_windows(texts: list[bytes], min_words: int = MIN_WORDS):
    """For each text with windows: (text, key, place, left, right), places counted from the text's first shingle;
    left and right are the shingles on both sides that a link takes in."""
    size, width = seed(min_words)
    values, first, last = laid_out(texts, width, size)
    gap = values == LARGEST
    own = mixed(values ^ np.uint64(0xA0761D6478BD642F))
    own[gap] = LARGEST
    place, begin, end = compact_windows(own, first, last, width)
    text = np.searchsorted(first, place, side="right") - 1
    # A text of fewer words can't hold a passage.
    long = last[text] - first[text] + size - 1 >= min_words
    place, begin, end, text = place[long], begin[long], end[long], text[long]
    at, count = place - first[text], last[text] - first[text] + size - SHINGLE
    # A text that repeats itself has its smallest run more than once; the link takes in the whole window.
    _, same, times = np.unique(begin * len(values) + end, return_inverse=True, return_counts=True)
    again = (times[same] > 1) | (own[place] == own[np.minimum(place + 1, len(own) - 1)])
    left = np.minimum(at, REACH + np.where(again, place - begin, 0))
    right = np.minimum(count - 1 - at, size - SHINGLE + REACH + np.where(again, end - place, 0))
    return text, own[place].view(np.int64), at, left, right


def joined(key, doc, place, left, right):
    """Windows joined to those of the smallest document of their key: (its windows, links of the others).

    A key may stand in a document again and again, where the document repeats itself: the first, second and next one
    meet the first, second and next one of the smallest document, from the start again when it has no more. So texts that repeat
    the same words as often are one link and not one for each repetition."""
    order = np.lexsort((place, doc, key))
    key, doc, place, left, right = (x[order] for x in (key, doc, place, left, right))
    if not len(key):
        return [key, doc, place, left, right], (doc, place, left, right, doc, place)
    index = np.arange(len(key))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    again = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    at = np.maximum.accumulate(np.where(new, index, 0))
    nth = index - np.maximum.accumulate(np.where(again, index, 0))
    own = doc == doc[at]
    times = np.bincount(at[own], minlength=len(key))
    link = ~own
    to = (at + nth % np.maximum(times[at], 1))[link]
    return (
        [x[own] for x in (key, doc, place, left, right)],
        (doc[link], place[link], left[link], right[link], doc[to], place[link] - place[to]),
    )


def _windows(first) -> pa.RecordBatch:
    key, doc, place, left, right = first
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(doc), *[pa.array(x.astype(np.int32)) for x in (place, left, right)],
         none, none.cast(pa.int32())], schema=WINDOW)


def _links(found) -> pa.RecordBatch:
    doc, place, left, right, other, shift = found
    # Links are done; their key only deals them out evenly.
    return pa.RecordBatch.from_arrays(
        [pa.array(mixed(doc.astype(np.uint64)).view(np.int64)), pa.array(doc),
         *[pa.array(x.astype(np.int32)) for x in (place, left, right)],
         pa.array(other), pa.array(shift.astype(np.int32))], schema=WINDOW)


FORM = "key long, doc_id long, place int, left int, right int, other long, shift int"


def to_smallest(rows: DataFrame, windows: Callable) -> DataFrame:
    """Windows joined to those of the smallest document of their key: rows of ``FORM`` with ``other`` and ``shift``.

    ``windows`` makes (text, key, place, left, right) of a part of the rows and its texts."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            first, found = joined(*[np.concatenate(c) for c in zip(*held, strict=True)])
            yield _windows(first)
            yield _links(found)

        for part, texts in parts(batches):
            text, key, place, left, right = windows(part, texts)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            held.append((key, ids[text], place, left, right))
            size += len(key)
            if size >= HELD:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            done = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
            if done.any():
                part = batch.filter(pa.array(done))
                yield _links([part.column(c).to_numpy(zero_copy_only=False)
                              for c in ("doc_id", "place", "left", "right", "other", "shift")])
            rows = [column(c)[~done] for c in ("key", "doc_id", "place", "left", "right")]
            if not len(rows[0]):
                continue
            # The smallest document of a key that the last batch ended with goes on.
            if last is not None and last[0][0] == rows[0][0]:
                rows = [np.concatenate(c) for c in zip(last, rows, strict=True)]
            first, found = joined(*rows)
            yield _links(found)
            ending = first[0] == first[0][-1]
            last = [c[ending] for c in first]

    return (
        rows.mapInArrow(within, FORM).repartition("key").sortWithinPartitions("key", "doc_id", "place")
        .mapInArrow(across, FORM)
    )


def links(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, other, shift, low, high): shingles low to high of a document that may repeat those of a smaller one,
    ``shift`` places before."""
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    met = to_smallest(slim, lambda part, texts: keyed_windows(texts, min_words))
    return met.groupBy("doc_id", "other", "shift").agg(
        F.min(F.col("place") - F.col("left")).alias("low"), F.max(F.col("place") + F.col("right")).alias("high"))


def slices(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """The regions asked for (doc_id, low, high and what else they have) with ``hashes``: their shingle hashes (four bytes
    each), cut at the text's end."""
    names = [c for c in regions.columns if c != "doc_id"]
    asked = regions.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("asked"))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").join(asked, "doc_id")
    low, high = names.index("low"), names.index("high")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in parts(batches):
            values, first, last = laid_out(texts, 1)
            small = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            asked = part.column("asked")
            of = asked.value_parent_indices()
            columns = asked.flatten().flatten()
            begin, end = first[of], last[of]
            begin, end = (np.minimum(begin + columns[c].to_numpy() + more, end) for c, more in ((low, 0), (high, 1)))
            hashes = pa.array([small[i:j].tobytes() for i, j in zip(begin, end, strict=True)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), *columns, hashes], ["doc_id", *names, "hashes"])

    return rows.mapInArrow(cut, T.StructType([regions.schema[c] for c in ["doc_id", *names]]).add("hashes", "binary"))


def equal_runs(x: np.ndarray, y: np.ndarray, at: int) -> list[tuple[int, int, int]]:
    """(first, after the last, step) of the runs of ``x`` that equal those of ``y`` at ``at`` places and up to
    ``STEPS`` more or less on."""
    out = []
    for step in sorted(range(-STEPS, STEPS + 1), key=abs):
        low, high = max(0, -(at + step)), min(len(x), len(y) - at - step)
        if high <= low:
            continue
        equal = x[low:high] == y[low + at + step : high + at + step]
        if not equal.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0])))) + low
        out += zip(edges[::2].tolist(), edges[1::2].tolist(), [step] * (len(edges) // 2), strict=True)
        if not step and out == [(0, len(x), 0)]:
            break
    return sorted(out)


def repeated(runs: list[tuple[int, int, int]], width: int, similarity: float) -> list[tuple[int, int, int, float]]:
    """(first, after the last, step, similarity) of the stretches that count as one passage."""
    out = []
    at, k = 0, 0
    while k < len(runs):
        low, high, step = runs[k]
        low = max(low, at)
        if high <= low:
            k += 1
            continue
        first, same, good, n = step, 0, None, k
        new = low
        # As many runs, with short gaps in both texts, as keep the stretch similar enough.
        while True:
            same += high - new
            alike = same / ((high - low) + (high + step - low - first) - same)
            if alike >= similarity and high - low >= width:
                good = (low, high, first, alike)
            best = None
            for m in range(n + 1, len(runs)):
                i, j, other = runs[m]
                if i > high + BRIDGE:
                    break
                i = max(i, high, high + step - other)
                gap, theirs = i - high, i + other - high - step
                if j > i and max(gap, theirs) <= BRIDGE:
                    best = max(best or (-2 * BRIDGE, 0, 0, 0, 0), (j - i - gap - theirs, m, i, j, other))
            if not best:
                break
            _, n, new, high, step = best
        if good:
            out.append(good)
            at = good[1]
        k += 1
    return out


def verified(docs: DataFrame, found: DataFrame, width: int, similarity: float) -> DataFrame:
    """The passages that links hold."""
    grain = lambda c: F.floor(c / GRAIN) * GRAIN
    found = found.withColumn("other_low", F.greatest(grain(F.col("low") - F.col("shift") - STEPS), F.lit(0)).cast("int")).withColumn(
        "other_high", (grain(F.col("high") - F.col("shift") + STEPS) + GRAIN - 1).cast("int"))
    mine = slices(docs, found).withColumnRenamed("hashes", "mine")
    regions = found.select(F.col("other").alias("doc_id"), F.col("other_low").alias("low"), F.col("other_high").alias("high"))
    theirs = slices(docs, regions.distinct()).toDF("other", "other_low", "other_high", "theirs")
    both = mine.hint("merge").join(theirs, ["other", "other_low", "other_high"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "other", "shift", "low", "other_low", "mine", "theirs"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
        for batch in batches:
            out = []
            for doc, other, shift, low, other_low, a, b in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
                runs = equal_runs(x, y, low - shift - other_low)
                for i, j, step, alike in repeated(runs, width, similarity):
                    out.append((doc, low + i, low + j + SHINGLE - 1, other, low + i - shift + step, alike))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["doc_id", "start_word", "end_word", "kept_doc_id", "kept_start", "similarity"])

    return both.mapInArrow(
        verify, "doc_id long, start_word int, end_word int, kept_doc_id long, kept_start int, similarity double"
    ).distinct()


def open_windows(docs: DataFrame, found: DataFrame, passed: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, place, open) of the windows of keys that have one in no passage, of a document that isn't their first.

    A window all of whose stretches lie in a passage with similarity 1 is left out: the smaller document has the same
    stretches around the same window."""
    met = found.select("doc_id").union(found.select("other")).distinct()
    equal = F.col("similarity") == 1 if "similarity" in passed.columns else F.lit(False)
    spans = passed.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word", equal.alias("equal"))).alias("spans"))
    size, _ = seed(min_words)
    run, width = size - SHINGLE + 1, min_words - SHINGLE + 1
    rows = (
        docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
        .join(met, "doc_id", "left_semi").join(spans, "doc_id", "left")
    )

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in parts(batches):
            text, key, place, left, right = keyed_windows(texts, min_words)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            still, copied = np.ones(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
            # Words of the stretches that hold a window, as far as the text goes.
            low, high = place - np.minimum(left, width - run), place + np.minimum(right, width - 1) + SHINGLE
            edges = np.searchsorted(text, np.arange(part.num_rows + 1))
            for i, spans in enumerate(part.column("spans").to_pylist()):
                own = slice(edges[i], edges[i + 1])
                for s in spans or []:
                    still[own] &= ~((place[own] >= s["start_word"]) & (place[own] + size <= s["end_word"]))
                    if s["equal"]:
                        # The place before tells whether the window is the first of equal ones in the other text too.
                        copied[own] |= (place[own] > 0) & (low[own] >= s["start_word"]) & (high[own] <= s["end_word"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(ids[text]), pa.array(place.astype(np.int32)), pa.array(still)],
                ["key", "doc_id", "place", "open"]).filter(pa.array(~copied))

    every = written(rows.mapInArrow(marked, "key long, doc_id long, place int, open boolean"), "passages-open")
    keys = every.groupBy("key").agg(F.min("doc_id").alias("least"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("most")).where("most > least")
    return salted_join(every, keys, ["key"], "doc_id").where("doc_id <= most").select("doc_id", "place", "open")


def runs_of(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` values in a row, by doubling."""
    whole, at, step, power = None, 0, 1, values
    while True:
        if width & step:
            n = len(values) - at - step + 1
            part = power[at : at + max(n, 0)]
            whole = part if whole is None else mixed(whole[: len(part)] * FACTOR + part)
            at += step
        if step * 2 > width:
            return whole
        power = mixed(power[: max(len(power) - step, 0)] * FACTOR + power[step:])
        step *= 2


# Places of a part as the low bits of a hash, so that the smallest one tells where it stands.
PLACE_BITS = 26


def open_stretches(part: pa.RecordBatch, texts: list[bytes], min_words: int):
    """For the stretches around the places asked for: (text, key, place, left, right), ``left`` being -1 where no
    open window is around, else the place from which the same stretch is the window's, ``right`` the hash function (-1: the stretch itself) and its last place."""
    size, _ = seed(min_words)
    run, width = size - SHINGLE + 1, min_words - SHINGLE + 1
    values, first, last = laid_out(texts, width)
    none = np.zeros(0, dtype=np.int64)
    if len(values) < width:
        return none, none, none, none, none
    # Stretches that hold an asked place, and those that hold an open one.
    asked, wanted = np.zeros(len(values) + 1, dtype=np.int64), np.zeros(len(values) + 1, dtype=np.int64)
    for i, places in enumerate(part.column("asked").to_pylist()):
        at = np.array([(p["place"], p["open"]) for p in places], dtype=np.int64).reshape(-1, 2)
        low = np.maximum(at[:, 0] + run - width, 0) + first[i]
        high = np.maximum(np.minimum(at[:, 0] + first[i], last[i] - width) + 1, low)
        for edge, which in ((asked, slice(None)), (wanted, at[:, 1] == 1)):
            np.add.at(edge, low[which], 1)
            np.add.at(edge, high[which], -1)
    start = np.flatnonzero(np.cumsum(asked)[: len(values) - width + 1] > 0)
    is_open = np.cumsum(wanted)[start] > 0
    text = np.searchsorted(first, start, side="right") - 1
    out = [(text, mixed(runs_of(values, width)[start]), start - first[text], np.where(is_open, 0, -1), np.full(len(start), -1))]
    place = np.arange(len(values), dtype=np.uint64)
    for k in range(HASHES):
        own = mixed(values ^ mixed(np.uint64(k + 1) * FACTOR))
        own[values == LARGEST] = LARGEST
        packed = (own >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place & np.uint64((1 << PLACE_BITS) - 1)
        least = (sliding(packed, width)[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        # A compact window: stretches one after the other with the same smallest shingle.
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1))) if len(least) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        end = np.concatenate((head[1:], [len(start)])) - 1 if len(head) else head
        at = np.add.reduceat(is_open, head) if len(head) else head
        out.append((text[head], mixed(own[least[head]] + np.uint64(k)), least[head] - first[text[head]],
                    np.where(at > 0, start[head] - first[text[head]], -1), (start[end] - start[head]) * HASHES + k))
    text, key, place, left, right = (np.concatenate(c) for c in zip(*out, strict=True))
    return text, key.view(np.int64), place, left, right


def late_links(docs: DataFrame, windows: DataFrame, min_words: int) -> DataFrame:
    """Links as those of ``links``, of stretches around open windows with the smallest documents that they agree with."""
    width = min_words - SHINGLE + 1
    asked = windows.groupBy("doc_id").agg(F.collect_list(F.struct("place", "open")).alias("asked"))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").join(asked, "doc_id")
    met = to_smallest(rows, lambda part, texts: open_stretches(part, texts, min_words)).where("left >= 0")
    pair = ["doc_id", "other", "shift"]
    whole = met.where("right < 0").select(*pair, "place")
    # Windows of a pair at one distance: how many hash functions agree in windows that begin by each one's last stretch and end
    # after it began. Each function's windows lie apart, so that counting those that cover a place counts functions.
    agreed = met.where("right >= 0").select(
        *pair, "place", F.col("left").alias("begin"), (F.col("left") + F.floor(F.col("right") / HASHES)).cast("int").alias("end")).distinct()
    events = agreed.select(*pair, F.explode(F.array(
        F.struct(F.col("begin").alias("at"), F.lit(1).alias("change")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("change")))).alias("e"))
    open_now = F.sum("e.change").over(W.partitionBy(*pair).orderBy("e.at").rangeBetween(W.unboundedPreceding, 0))
    enough = events.withColumn("agree", open_now).where(F.col("agree") >= ENOUGH).select(*pair, F.col("e.at").alias("place"))
    return whole.union(enough).groupBy(*pair).agg(
        F.min(F.greatest(F.col("place") - AROUND, F.lit(0))).alias("low"), F.max(F.col("place") + width + AROUND).alias("high"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start_word, end_word, kept_doc_id, kept_start, similarity): words of a document that repeat those of
    one with a smaller id. Words are counted from 0, the end is not included."""
    width = min_words - SHINGLE + 1
    found = written(links(docs, min_words), "passages-links")
    met = found.select("doc_id").union(found.select("other")).distinct()
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    with laid_by(slim, "doc_id", met, "passages-texts") as texts:
        passed = written(verified(texts, found, width, similarity), "passages-found")
        windows = open_windows(texts, found, passed, min_words)
        late = written(late_links(texts, windows, min_words), "passages-late")
        more = written(verified(texts, late, width, similarity), "passages-late-found")
    dropped(found)
    dropped(late)
    return passed.union(more).distinct()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the passages that a smaller document has; ``n_chars`` is counted anew. Every document
    stays, one that is all repeats with an empty text."""
    spans = repeated_passages(docs, min_words, similarity).groupBy("doc_id").agg(
        F.collect_set(F.struct("start_word", "end_word")).alias("spans_"))
    rows = docs.join(spans, "doc_id", "left")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in parts(batches):
            words = Words(texts, SPACED)
            new = []
            for i, (text, spans) in enumerate(zip(texts, part.column("spans_").to_pylist(), strict=True)):
                base, first = int(words.at[i]), int(words.first[i])
                kept, at = [], 0
                for s in sorted(spans or [], key=lambda s: (s["start_word"], s["end_word"])):
                    if first + s["start_word"] >= words.first[i + 1]:
                        break  # a passage of a longer text with the same id
                    low = int(words.starts[first + s["start_word"]]) - base
                    last = first + s["end_word"]
                    high = int(words.starts[last]) - base if last < words.first[i + 1] else len(text)
                    kept.append(text[at : max(low, at)])
                    at = max(at, high)
                new.append((b"".join(kept) + text[at:]).decode("utf-8", "replace") if spans else None)
            old = part.column("text").to_pylist()
            columns = [pa.array([o if n is None else n for o, n in zip(old, new, strict=True)], type=pa.string())
                       if c == "text" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out

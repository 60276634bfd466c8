"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting is two grouped sums, each of which travels as packed sorted arrays rather than a row for each entry: tasks sum
what they read, cut the sums into buckets by hash (of the word, or of the word pair, so that a frequent word is spread
over all buckets) and every bucket is merged by one task, which writes its arrays. The pair buckets hand on the sums that
smoothing needs of each first and second word, which a third step merges by ranges of word numbers.

Arrays, in a folder that all machines mount (``spark.checkpoint.dir``): for each bucket of words the sorted 64-bit hashes
and counts (a word's number is its place in the sorted whole); for each bucket of pairs the sorted hashes of number
pairs (a one-to-one mix, so exact) and counts; for each range of word numbers the totals. Workers map the files and
look up a part's sorted distinct keys at a time, so a worker's own memory doesn't grow with the model. Files are
renamed into place when they are whole: a task that is run again replaces them.

    p(w | v) = max(c(vw) - D(c), 0) / c(v.) + g(v) p(w),   p(w) = max(n(.w) - D'(n), 0) / n(..) + g' / (V + 1)

with Kneser-Ney's n(.w), the number of words before w, the modified discounts D for counts 1, 2 and more, and an unknown
word as one more word of the vocabulary. Texts begin after a start mark and end with an end, which is a token.

Defined results: no text counts as empty and has the end alone; rows without an id are learnt from and not held out;
repeated rows are texts of their own; with nothing to learn from, every token has the base probability 1 and so has the model (scores
0); other columns are left out; an empty table gives an empty result. Words count as equal if their 64-bit hashes are.
Counts are whole numbers of 64 bits. More than ``MOST_WORDS`` distinct words raise an error.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.shared import scratch_path
from storelens.llm.words import SPACED, Words, mixed, parts

# Entries that a task sums up before it sends them.
HELD = 2_000_000
END = np.uint64(0x0E4D0E4D0E4D0E4D)
# A word's number, and that of the start mark, takes half of a pair's 64 bits.
MOST_WORDS = 2**32 - 2
STATS = ["total", "one", "two", "more", "before"]
BLOB = "bucket int, a binary, b binary, c binary"


def mounted(spark: SparkSession) -> str:
    """A new folder for arrays, as a path that workers can map files of."""
    path = scratch_path(spark, "kneser-ney")
    if "://" in path and not path.startswith("file://"):
        raise RuntimeError(f"the model's arrays need a folder that all machines mount, not {path}")
    path = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Written beside its place and renamed."""
    beside = f"{folder}/.{name}-{os.getpid()}"
    values.tofile(beside)
    os.replace(beside, f"{folder}/{name}")


def _load(folder: str, name: str, kind: type) -> np.ndarray:
    """The file mapped; the mapping holds no descriptor open."""
    with open(f"{folder}/{name}", "rb") as file:
        if not os.fstat(file.fileno()).st_size:
            return np.zeros(0, dtype=kind)
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), dtype=kind)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits each where all of them fit, otherwise in 64."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64)


def width(size: int, n: int) -> type:
    """The type of ``n`` narrowed counts that take ``size`` bytes."""
    return np.uint64 if n and size == 8 * n else np.uint32


def widened(data: bytes, n: int) -> np.ndarray:
    """``n`` narrowed counts as whole numbers of 64 bits."""
    return np.frombuffer(data, dtype=width(len(data), n)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.add.reduceat(counts[order], at)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first bits, so that buckets follow one another in order."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def _cut(keys: np.ndarray, buckets: np.ndarray, number: int) -> Iterator[tuple[int, slice]]:
    """Stretches of equal bucket; buckets are in order."""
    edges = np.searchsorted(buckets, np.arange(number + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, slice(edges[b], edges[b + 1])


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "a", "b", "c"])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, one text after the other, and where each text begins."""
    words = Words(texts, SPACED)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, dtype=np.uint64)
    at = np.arange(len(words.starts)) + words.text_of_word()
    out[at] = words.hashes()
    return out, first


class Layout(NamedTuple):
    """Where the arrays lie, and the sums over the whole corpus."""

    folder: str
    bits: int
    offsets: np.ndarray  # words before each bucket
    n: int  # training tokens
    v: int  # distinct ones
    range_size: int = 1
    discounts: tuple = ()  # of pairs, and of the words before
    types: int = 0
    rest: float = 0.0  # what the discounts leave to the uniform distribution


class Dictionary:
    """Numbers and counts of words by hash, from mapped arrays."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        number = 1 << layout.bits
        self.hashes = [_load(layout.folder, f"words-{b}", np.uint64) for b in range(number)]
        self.counts = [_load(layout.folder, f"words-{b}-counts", np.int64) for b in range(number)]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each hash."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        buckets = bucket_of(distinct, self.layout.bits)
        for b, s in _cut(distinct, buckets, 1 << self.layout.bits):
            at, here = _places(self.hashes[b], distinct[s])
            ids[s] = np.where(here, at + self.layout.offsets[b], -1)
            if here.any():
                counts[s] = np.where(here, self.counts[b][at], 0)
        return ids[back], counts[back]


def _places(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key (0 where it is not there), and whether it is there."""
    if not len(array):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(array, keys)
    at[at == len(array)] = 0
    here = array[at] == keys
    return np.where(here, at, 0), here


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Number pairs as one 64-bit hash each, one to one."""
    return mixed(before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))


def unpaired(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of hashed pairs: ``mixed`` undone."""
    def back(x: np.ndarray, shift: int) -> np.ndarray:
        out = x
        for _ in range(64 // shift):
            out = x ^ (out >> np.uint64(shift))
        return out

    x = back(keys, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    x = back(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    x = back(x, 30)
    return (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def before_each(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; the start mark before a text's first."""
    out = np.concatenate(([start], ids[:-1])) if len(ids) else ids
    out[first[:-1]] = start
    return out


def count_words(texts: DataFrame, folder: str, bits: int) -> Layout:
    """Write the arrays of words."""

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return _blobs([(b, keys[s].tobytes(), counts[s].tobytes(), b"")
                           for b, s in _cut(keys, bucket_of(keys, bits), 1 << bits)])

        for _, x in parts(batches):
            hashes, _ = tokens(x)
            held.append(summed(hashes, np.ones(len(hashes), dtype=np.int64)))
            size += len(held[-1][0])
            if size >= HELD:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for b, blobs in by_bucket(batches):
            keys, counts = summed(np.concatenate([np.frombuffer(a, dtype=np.uint64) for a, _, _ in blobs]),
                                  np.concatenate([np.frombuffer(c, dtype=np.int64) for _, c, _ in blobs]))
            _save(folder, f"words-{b}", keys)
            _save(folder, f"words-{b}-counts", counts)
            out.append((b, len(keys), int(counts.sum())))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], ["bucket", "n", "total"])

    sums = texts.mapInArrow(part_sums, BLOB)
    done = dealt(sums, 1 << bits).mapInArrow(merge, "bucket long, n long, total long").collect()
    sizes = np.zeros((1 << bits) + 1, dtype=np.int64)
    for r in done:
        sizes[r["bucket"] + 1] = r["n"]
    for b in set(range(1 << bits)) - {r["bucket"] for r in done}:
        for name in (f"words-{b}", f"words-{b}-counts"):
            _save(folder, name, np.zeros(0, dtype=np.uint64))
    distinct = int(sizes.sum())
    if distinct > MOST_WORDS:
        raise ValueError(f"{distinct} distinct words; numbers of pairs hold {MOST_WORDS}")
    return Layout(folder, bits, np.cumsum(sizes), sum(r["total"] for r in done), distinct)


def dealt(blobs: DataFrame, number: int) -> DataFrame:
    return blobs.repartition(number, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its blobs), from rows in order of the bucket."""
    now, held = None, []
    for batch in batches:
        for b, *blob in zip(*[batch.column(c).to_pylist() for c in ("bucket", "a", "b", "c")], strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, held


def count_pairs(texts: DataFrame, layout: Layout) -> Layout:
    """Write the arrays of pairs and of the sums that smoothing needs; work out the discounts."""
    folder, bits = layout.folder, layout.bits
    number = 1 << bits
    # One more number for the start mark.
    range_size = -(-(layout.v + 1) // number)

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary(layout)
        held, size = [], 0

        def send() -> pa.RecordBatch:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            rows = []
            for b, s in _cut(keys, bucket_of(keys, bits), number):
                # In order of the numbers they pack better than in order of the hashes.
                u, w = unpaired(keys[s])
                order = np.lexsort((w, u))
                u, w, c = u[order], w[order], counts[s][order]
                rows.append((b, np.diff(u, prepend=0).astype(np.uint32).tobytes(), w.astype(np.uint32).tobytes(),
                             narrow(c).tobytes()))
            return _blobs(rows)

        for _, x in parts(batches):
            hashes, first = tokens(x)
            ids, _ = words.find(hashes)
            keys = pair_keys(before_each(ids, first, layout.v), ids)
            held.append(summed(keys, np.ones(len(keys), dtype=np.int64)))
            size += len(held[-1][0])
            if size >= HELD:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in by_bucket(batches):
            keys = np.concatenate([
                pair_keys(np.cumsum(np.frombuffer(u, dtype=np.uint32), dtype=np.int64), np.frombuffer(w, dtype=np.uint32))
                for u, w, _ in blobs])
            keys, counts = summed(keys, np.concatenate([widened(c, len(w) // 4) for _, w, c in blobs]))
            _save(folder, f"pairs-{b}", keys)
            _save(folder, f"pairs-{b}-counts", narrow(counts))
            # Bucket -1 takes how many pairs stand once, twice, three and four times, and all of them.
            yield _blobs([(-1, np.array([*(np.count_nonzero(counts == k) for k in range(1, 5)), len(keys)],
                                        dtype=np.int64).tobytes(), b"", b"")])
            u, w = unpaired(keys)
            stats = [counts, counts == 1, counts == 2, counts > 2]
            ids, back = np.unique(u, return_inverse=True)
            sums = np.zeros((len(ids), len(stats)), dtype=np.int64)
            for k, s in enumerate(stats):
                np.add.at(sums[:, k], back, s.astype(np.int64))
            yield from _stretches(ids, sums, range_size, number, b"u")
            ids, before = np.unique(w, return_counts=True)
            yield from _stretches(ids, before[:, None].astype(np.int64), range_size, number, b"w")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in by_bucket(batches):
            if b < 0:
                found = np.sum([np.frombuffer(a, dtype=np.int64) for a, _, _ in blobs], axis=0)
                yield _blobs([(b, found.tobytes(), b"", b"")])
                continue
            whole = np.zeros((range_size, len(STATS)), dtype=np.int64)
            for ids, sums, kind in blobs:
                at = np.cumsum(np.frombuffer(ids, dtype=np.uint32), dtype=np.int64)
                columns = slice(0, 4) if kind == b"u" else slice(4, 5)
                n = len(at) * (columns.stop - columns.start)
                whole[at, columns] += widened(sums, n).reshape(len(at), -1)
            for k, name in enumerate(STATS):
                _save(folder, f"{name}-{b}", whole[:, k])
            before = whole[:, 4]
            yield _blobs([(b, np.array([*(np.count_nonzero(before == k) for k in range(1, 5)),
                                        np.count_nonzero(before > 2)], dtype=np.int64).tobytes(), b"", b"")])

    sums = dealt(texts.mapInArrow(part_sums, BLOB), number).mapInArrow(merge, BLOB)
    rows = dealt(sums, number).mapInArrow(finish, BLOB).select("bucket", "a").collect()
    there = {r["bucket"] for r in rows}
    for b in set(range(number)) - there:
        for name in STATS:
            _save(folder, f"{name}-{b}", np.zeros(range_size, dtype=np.int64))
    for b in range(number):
        for name in (f"pairs-{b}", f"pairs-{b}-counts"):
            if not os.path.exists(f"{folder}/{name}"):
                _save(folder, name, np.zeros(0, dtype=np.uint64))
    seen = np.sum([np.frombuffer(r["a"], dtype=np.int64) for r in rows if r["bucket"] < 0] or [np.zeros(5)], axis=0)
    words = np.sum([np.frombuffer(r["a"], dtype=np.int64) for r in rows if r["bucket"] >= 0] or [np.zeros(5)], axis=0)
    types = int(seen[4])
    own = discounts(words[:4])
    rest = (own[0] * words[0] + own[1] * words[1] + own[2] * words[4]) / types if types else 1.0
    return layout._replace(range_size=range_size, discounts=(discounts(seen[:4]), own), types=types, rest=float(rest))


def _stretches(ids: np.ndarray, sums: np.ndarray, range_size: int, number: int, kind: bytes):
    rows = [
        (b, np.diff(ids[s] - b * range_size, prepend=0).astype(np.uint32).tobytes(),
         narrow(sums[s]).tobytes(), kind)
        for b, s in _cut(ids, ids // range_size, number)
    ]
    if rows:
        yield _blobs(rows)


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified discounts from how many entries have counts 1 to 4; fixed ones where these don't give any."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return found if all(0 < d < k for k, d in enumerate(found, 1)) else (0.5, 1.0, 1.5)


def discounted(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(counts - np.choose(np.clip(counts, 0, 3).astype(int), (0.0, *d)), 0)


class Model:
    """Probabilities from mapped arrays."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.words = Dictionary(layout)
        number = range(1 << layout.bits)
        self.pairs = [_load(layout.folder, f"pairs-{b}", np.uint64) for b in number]
        self.counts = [
            _load(layout.folder, name, width(os.path.getsize(f"{layout.folder}/{name}"), len(keys)))
            for name, keys in zip([f"pairs-{b}-counts" for b in number], self.pairs, strict=True)]
        self.stats = {name: [_load(layout.folder, f"{name}-{b}", np.int64) for b in number] for name in STATS}

    def stat(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A sum of each word number; 0 for unknown words."""
        distinct, back = np.unique(ids, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        known = np.maximum(distinct, 0)
        for b, s in _cut(known, known // self.layout.range_size, len(self.pairs)):
            out[s] = self.stats[name][b][known[s] - b * self.layout.range_size]
        out[distinct < 0] = 0
        return out[back]

    def pair_counts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        known = np.flatnonzero((before >= 0) & (ids >= 0))
        distinct, back = np.unique(pair_keys(before[known], ids[known]), return_inverse=True)
        found = np.zeros(len(distinct), dtype=np.int64)
        for b, s in _cut(distinct, bucket_of(distinct, self.layout.bits), len(self.pairs)):
            at, here = _places(self.pairs[b], distinct[s])
            if here.any():
                found[s] = np.where(here, self.counts[b][at], 0)
        out[known] = found[back]
        return out

    def probabilities(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """p(word | word before) of each token."""
        m = self.layout
        d, own = m.discounts
        single = discounted(self.stat("before", ids), own) / max(m.types, 1) + m.rest / (m.v + 1)
        total = self.stat("total", before)
        left = sum(k * self.stat(name, before) for k, name in zip(d, STATS[1:4], strict=True))
        some = np.maximum(total, 1)
        return np.where(total > 0, discounted(self.pair_counts(before, ids), d) / some + left / some * single, single)


SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64())])


def trained(texts: DataFrame) -> Layout:
    """A model of all rows' ``text``; its arrays lie in the shared folder."""
    # As many buckets as tasks read the texts, so a bucket stays as large as the data of a task.
    bits = max(4, (texts.rdd.getNumPartitions() - 1).bit_length())
    layout = count_words(texts, mounted(texts.sparkSession), bits)
    return count_pairs(texts, layout)


def scored(docs: DataFrame, layout: Layout) -> DataFrame:
    """Token counts, add-one score and the model's log10 probability of each (doc_id, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(layout)
        for rows, x in parts(batches):
            hashes, first = tokens(x)
            ids, counts = model.words.find(hashes)
            each = [np.ones(len(ids)), counts > 0]
            if layout.n:
                each += [np.log10((counts + 1) / (layout.n + layout.v + 1)),
                         np.log10(model.probabilities(before_each(ids, first, layout.v), ids))]
            else:
                each += [np.zeros(len(ids))] * 2
            sums = [np.add.reduceat(e.astype(np.float64), first[:-1]) for e in each]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *[pa.array(s.astype(np.int64)) for s in sums[:2]],
                 *[pa.array(s) for s in sums[2:]]], schema=SCORED)

    return docs.select("doc_id", "text").mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def language_model(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows scored by a model of those that are not held out."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    layout = trained(slim.where("not held_out").select("text"))
    return scored(slim, layout).select(
        "doc_id", "n_tokens", "n_known", F.lit(layout.n).cast("long").alias("train_tokens"), "base_score", "score")

"""SimHash near-duplicates, with fingerprints compared in vertical bit planes.

``fingerprints`` gives every text 64 bits: each 3-word shingle's XXH64 votes on every bit. Equal fingerprints are one
node from there on, so a group of copies of any size is one row. Two fingerprints that differ in at most ``radius``
bits agree in at least ``PIECES - radius`` of ``PIECES`` pieces; one key is made of each choice of so many pieces, and
fingerprints that share a key meet. Rows of a key are compared in blocks of at most about ``BLOCK``: a key with more is
cut into blocks by hash, and each pair of blocks is a task's work of its own. Within a block the bits are stored
vertically (one row of machine words for each bit); the distance of many pairs is counted at once with carry-save
counters, and a tile is left as soon as all of its pairs are beyond the radius. A block gives links to the smallest of
each of its components, never all pairs, and ``shared.components`` joins the blocks.

Defined results: a text that is null, empty or white space has fingerprint zero and is linked like any other; one with
fewer than three words has one shingle of them all; a bit is set by more than half of the votes, so a tie clears it;
rows without an id keep their fingerprint and give the component no name; repeated rows come out as often as they
went in. Other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import components, salted_join, written
from storelens.llm.words import Words, parts

SHINGLE = 3
RADIUS = 2
PIECES = 4
BLOCK = 4096
# Runs of keys with few rows are compared together up to so many rows.
TOGETHER = 512
SEED = 42

# For each byte, its bits as eight counters of a byte each.
SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
          .view(np.uint64).ravel())


def votes_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits of the hashes from each place of ``first`` to the next; zero where there are none."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = first[full]
    # A counter of one byte takes 255 votes: longer texts are summed in steps of that.
    steps = -(-counts[full] // 255)
    of = np.repeat(np.arange(len(full)), steps)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
    lanes = SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, begin[of] + 255 * inner, axis=0)
    bits = np.ascontiguousarray(sums).view(np.uint8).reshape(len(of), 64)
    total = np.add.reduceat(bits, np.cumsum(steps) - steps, axis=0, dtype=np.int64)
    won = total * 2 > counts[full, None]
    out[full] = np.packbits(won, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def hashed(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of texts."""
    words = Words(texts)
    # The words with one space after each; shingle i is then one stretch of bytes.
    is_word = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(is_word, words.starts, 1)
    np.add.at(is_word, words.ends, -1)
    inside = np.cumsum(is_word[:-1]).astype(bool)
    data = words.data.copy()
    data[words.ends] = 32
    inside[words.ends] = True
    raw = data[inside].tobytes()
    ends = np.cumsum(words.ends - words.starts + 1) - 1
    starts = ends - (words.ends - words.starts)
    counts = words.counts
    many = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(many)))
    at = np.repeat(words.first[:-1], many) + np.arange(first[-1]) - np.repeat(first[:-1], many)
    last = at + np.repeat(np.minimum(counts, SHINGLE), many) - 1
    digest = xxhash.xxh64_intdigest
    values = [digest(raw[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)]
    return votes_of(np.array(values, dtype=np.uint64), first)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(hashed(texts).view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(compute, "doc_id long, fp long")


def piece_keys(fp: str = "fp", radius: int = RADIUS, pieces: int = PIECES):
    """An array of one long for each choice of ``pieces - radius`` pieces of the fingerprint."""
    width = 64 // pieces
    out = []
    for number, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        mask = sum(((1 << width) - 1) << (width * p) for p in chosen)
        mask -= (1 << 64) * (mask >> 63)
        out.append(F.xxhash64(F.lit(number), F.col(fp).bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*out)


def close_pairs(values: np.ndarray, radius: int = RADIUS, tile: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(place, earlier places within the radius) of the places that have any."""
    n = len(values)
    words = -(-n // 64)
    bits = np.zeros((64, words * 64), dtype=np.uint8)
    bits[:, :n] = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    order = np.arange(words * 64)
    counters = (radius + 1).bit_length()
    for low in range(0, n, tile):
        high = min(n, low + tile)
        width = -(-high // 64)
        # Pairs with a later place or itself are out from the start.
        out = np.packbits(order[None, : width * 64] >= np.arange(low, high)[:, None], axis=1,
                          bitorder="little").view(np.uint64)
        sums = [np.zeros_like(out) for _ in range(counters)]
        for b in range(64):
            own = np.zeros(high - low, dtype=np.uint64) - bits[b, low:high].astype(np.uint64)
            carry = planes[b, None, :width] ^ own[:, None]
            for k in range(counters):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            beyond = np.full_like(out, ~np.uint64(0))
            for k in range(counters):
                beyond &= sums[k] if (radius + 1) >> k & 1 else ~np.uint64(0)
            out |= beyond | carry
            if b >= radius and b % 4 == 3 and not (~out).any():
                break
        else:
            left = np.unpackbits((~out).view(np.uint8), axis=1, bitorder="little").astype(bool)
            for i in np.flatnonzero(left.any(axis=1)):
                yield low + int(i), np.flatnonzero(left[i])


def linked(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint, the place of the first one of its component."""
    label = np.arange(len(values))
    for i, near in close_pairs(values, radius):
        roots = np.unique(label[near])
        label[i] = roots[0]
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]
    return label


def links(prints: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that are within the radius."""
    keyed = prints.select("fp", F.explode(piece_keys("fp", radius, pieces)).alias("key"))
    # Written, so that the join meets it as a plain table and Spark can split the rows of a key with many.
    many = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), "blocks")
    dealt = (
        keyed.join(many, "key").withColumn("blocks", blocks).withColumn("own", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("fp", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None

        def found() -> pa.RecordBatch:
            values = np.unique(np.concatenate(held))
            label = linked(values.view(np.uint64), radius)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(values[at]), pa.array(values[label[at]])], ["a", "b"])

        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y")], axis=1)
            turns = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1 if len(fp) else []
            for a, b in zip([0, *turns], [*turns, len(fp)], strict=True):
                if a == b:
                    continue
                if tuple(group[a]) != last and size >= TOGETHER:
                    yield found()
                    held.clear()
                    size = 0
                last = tuple(group[a])
                held.append(fp[a:b])
                size += b - a
        if held:
            yield found()

    return (
        dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        .mapInArrow(compare, "a long, b long")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    pieces: int = PIECES) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id reachable over links of the radius."""
    prints = written(fingerprints(docs, key, text), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius, pieces), "simhash-links")
    # A node without links is its own root.
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(salted_join(placed.select("fp", "root"), named, ["root"], "fp").select("fp", "component_id"),
                 "simhash-nodes")
    return salted_join(prints, of, ["fp"], "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

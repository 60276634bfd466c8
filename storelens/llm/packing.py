"""Online packing of tokenised documents into windows, with a fixed number of open windows for each partition.

A document's ids come from a tokenizer file and end with one more id. Documents are taken as they stream by: whole
windows are cut off a document that is longer than a window, and the rest goes, uncut, to the open window that it
leaves fullest (best fit). When it fits none, the fullest open window is emitted and a new one opened, so a task holds
``OPEN`` windows whatever the size of its partition. What is open at the end of the partitions, at most ``OPEN``
windows each, is merged: the leftovers of ``MERGE`` partitions are packed by best fit in order of falling length, and
windows that stay under ``ENOUGH`` full are strung together, cut into whole windows and at last into sequences of powers
of two, which need no padding.

Defined results: no text counts as empty and gives a piece of the end id alone; rows without an id are packed like any
other; rows with the same id are documents of their own (their pieces have the same id); other columns are left out; an
empty table gives an empty result. Sequence numbers are unique, but not dense.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import written
from storelens.llm.tokens import texts_encoder
from storelens.llm.words import parts

WINDOW = 4096
END = 2
OPEN = 64
MERGE = 16
ENOUGH = 0.98

PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
# Pieces of open windows keep their ids, so that the merge may cut them.
LEFT = PIECE.append(pa.field("ids", pa.binary()))
COLUMNS = ", ".join(f"{name} long" for name in PIECE.names)


def best_fit(free: dict[int, int], size: int) -> int | None:
    """The window with the least space that still takes ``size``."""
    fitting = [(space, w) for w, space in free.items() if space >= size]
    return min(fitting)[1] if fitting else None


def pack(documents: Iterator[tuple[int | None, bytes]], window: int, slots: int, first: int):
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of full windows, and at the end those of open ones.

    ``documents`` gives ids as bytes of four each. Yields (open, pieces).
    """
    free: dict[int, int] = {}
    held: dict[int, list[tuple]] = {}
    following = first
    for number, raw in documents:
        total = len(raw) // 4
        start = 0
        while total - start >= window:
            yield False, [(number, start, raw[4 * start : 4 * (start + window)], total, following, 0)]
            following += 1
            start += window
        size = total - start
        if not size:
            continue
        at = best_fit(free, size)
        if at is None:
            if len(free) >= slots:
                fullest = min(free, key=lambda w: (free[w], w))
                del free[fullest]
                yield False, held.pop(fullest)
            at = following
            following += 1
            free[at], held[at] = window, []
        held[at].append((number, start, raw[4 * start :], total, at, window - free[at]))
        free[at] -= size
        if not free[at]:
            del free[at]
            yield False, held.pop(at)
    for pieces in held.values():
        yield True, pieces


def repack(pieces: list[tuple], window: int, first: int) -> list[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens) packed by best fit in order of falling length; cut where that saves padding."""
    spaces: list[list[int]] = [[] for _ in range(window + 1)]
    held: dict[int, list[tuple]] = {}
    following = first
    for piece in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1])):
        size = len(piece[2]) // 4
        space = next((s for s in range(size, window + 1) if spaces[s]), None)
        if space is None:
            at, space = following, window
            following += 1
            held[at] = []
        else:
            at = spaces[space].pop()
        held[at].append((*piece, at, window - space))
        spaces[space - size].append(at)
    out, loose = [], []
    for space, windows in enumerate(spaces):
        for at in windows:
            if window - space >= ENOUGH * window:
                out += held[at]
            else:
                loose += [piece[:4] for piece in held[at]]
    # The others are strung together and cut into whole windows, and what is left into powers of two.
    rest = sum(len(raw) // 4 for _, _, raw, _ in loose)
    sizes = [window] * (rest // window) + [1 << b for b in range(window.bit_length(), -1, -1) if rest % window >> b & 1]
    room = offset = 0
    for number, start, raw, total in loose:
        while raw:
            if not room:
                room, offset, at = sizes.pop(0), 0, following
                following += 1
            part = raw[: 4 * room]
            size = len(part) // 4
            out.append((number, start, part, total, at, offset))
            raw, start, room, offset = raw[len(part) :], start + size, room - size, offset + size
    return out


def _batch(pieces: list[tuple], keep: bool, schema: pa.Schema) -> pa.RecordBatch:
    rows = [(d, s, len(raw) // 4, zlib.crc32(raw), t, w, o, raw if keep else None) for d, s, raw, t, w, o in pieces]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
           end: int = END, slots: int = OPEN) -> DataFrame:
    """One row for each piece of a document in a sequence."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = texts_encoder(tokenizer)
        last = end.to_bytes(4, "little")

        def documents():
            for batch, texts in parts(batches):
                for number, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                    yield number, ids + last

        ready: list[tuple] = []
        for is_open, pieces in pack(documents(), window, slots, TaskContext.get().partitionId() << 33):
            if is_open:
                yield _batch(pieces, True, LEFT)
                continue
            ready += pieces
            if len(ready) >= 1000:
                yield _batch(ready, False, LEFT)
                ready = []
        if ready:
            yield _batch(ready, False, LEFT)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "doc_id", "start", "ids", "doc_tokens"]
        group, held = None, []
        done = lambda: _batch(repack(held, window, (1 << 62) + (group << 33)), False, PIECE)
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if row[0] != group:
                    if held:
                        yield done()
                    group, held = row[0], []
                held.append(row[1:])
        if held:
            yield done()

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(slim.mapInArrow(stream, f"{COLUMNS}, ids binary"), "packing")
    left = pieces.where("ids is not null").withColumn("group", F.shiftright("sequence_id", 33) / MERGE)
    left = left.withColumn("group", F.floor("group")).select("group", "doc_id", "start", "ids", "doc_tokens")
    merged = left.repartition("group").sortWithinPartitions("group").mapInArrow(merge, COLUMNS)
    return pieces.where("ids is null").drop("ids").unionByName(merged)


def public_tokenizer(name: str) -> str:
    """Path of a tokenizer file of the machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))

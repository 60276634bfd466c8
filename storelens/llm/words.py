"""Words of many texts at once, as NumPy arrays over the bytes of the texts.

Texts are handled in parts of about a megabyte (a longer text is a part of its own), so a task holds arrays of that
size and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PART_BYTES = 1 << 20
# Bytes whose words are hashed at once.
BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words between white space, and words of digits, letters and all that isn't ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def parts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in parts, and their texts as UTF-8; no text counts as an empty one."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
        first = size = 0
        for i, x in enumerate(texts):
            size += len(x) + 1
            if size >= PART_BYTES or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


class Words:
    """Words of a part: ``data`` the bytes (A-Z lower), word i at ``starts[i]:ends[i]``, text d's words from
    ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, texts: list[bytes], kind: np.ndarray = SPACED, lower: bool = True,
                 between: bytes = b" ") -> None:
        raw = np.frombuffer(between.join(texts) + between, dtype=np.uint8)
        self.data = LOWER[raw] if lower else raw
        is_word = kind[self.data]
        turns = np.flatnonzero(np.diff(np.concatenate(([False], is_word))))
        self.starts, self.ends = turns[::2], turns[1::2]
        self.at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
        self.first = np.searchsorted(self.starts, self.at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, by blocks of bytes, so that a long text needs no longer tables than a short one."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        up, down = powers(BLOCK_BYTES)
        at = 0
        while at < len(out):
            low = int(self.starts[at])
            to = int(np.searchsorted(self.ends, low + BLOCK_BYTES, side="right"))
            if to > at:
                block = self.data[low : self.ends[to - 1]]
                sums = np.zeros(len(block) + 1, dtype=np.uint64)
                np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
                starts = self.starts[at:to] - low
                out[at:to] = (sums[self.ends[at:to] - low] - sums[starts]) * down[starts]
            else:
                # A word longer than a block, block by block.
                to, total, power = at + 1, 0, 1
                for b in range(low, int(self.ends[at]), BLOCK_BYTES):
                    block = self.data[b : min(b + BLOCK_BYTES, int(self.ends[at]))]
                    part = int(((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)]).sum(dtype=np.uint64))
                    total = (total + part * power) % 2**64
                    power = power * pow(int(FACTOR), BLOCK_BYTES, 2**64) % 2**64
                out[at] = total
            at = to
        return mixed(out)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (FACTOR, INVERSE):
        a = np.full(n, x, dtype=np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; the last ``size - 1`` places of a text mix with the next one."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * FACTOR + words[k : k + n]
    return mixed(out)

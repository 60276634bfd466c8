"""Spelling variants: words that differ by one letter, found in a trie of letter-group counts.

Letters are dealt to ``GROUPS`` groups. A word's vector counts its letters of each group; the words are arranged in a trie
whose level k branches by the count of group k. Putting in a letter adds one to one count, leaving one out takes one off,
and another letter in place of one does both at most. A search therefore goes down the trie depth first with a budget
of one surplus and one deficit: a branch is entered only if what its count differs from the searched word's by is
still in the budget. All words that search a trie go down together, each with its own budget. Words at the leaves they
reach are verified letter by letter, after a test that either the first or the second halves are equal, which one
changed letter always leaves.

The trie is cut into its subtries below the first ``ROUTED`` levels. Counts are capped at 15, so there are at most 16 to
the power of ``ROUTED`` of them, whatever the table, and their sizes are known before words are sent. Words go to their
own subtrie to be searched and to the others that their budget can reach to search, but of two subtries only the words
of the smaller go to the larger: nearness works both ways, so no task gets more searching words than about twenty times the
words it holds. A subtrie of more than ``NODE_WORDS`` words is dealt to several tasks by the halves of its words, under
which any two near words still meet. Nothing is capped: every near pair is found once.

Counting is done within each task first. Results are counts and best words for each word, never lists of pairs; roots
are found by doubling the steps along the forms.

Defined results: no text has no words; rows without an id count with their words as they are, none of their letters
deleted; repeated rows count each time; other columns are left out; an empty table gives an empty result. Texts and words
of any length are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import written
from storelens.llm.words import FACTOR, LOWER, mixed, powers

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LETTERS = 5
MIN_COUNT = 3
TYPO_EVERY = 97
# A word is a form of one that is so many times as frequent.
FORM_RATIO = 2

GROUPS = 10
ROUTED = 4
CAP = 15
NODE_WORDS = 20_000
# Words that a task counts before it sends them, subtries small enough to compare at once, and pairs to test at once.
HELD = 200_000
SMALL = 16
PAIRS = 1 << 20

# Frequent letters have a group of their own; rarer ones share.
_BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxqjz"
GROUP_OF = np.arange(256) % GROUPS
for _i, _letter in enumerate(_BY_FREQUENCY):
    GROUP_OF[ord(_letter)] = _i % GROUPS


def letter_deleted(word: str, h: int) -> str:
    """The word without its letter at ``h`` modulo its length, where ``TYPO_EVERY`` divides ``h``."""
    if h % TYPO_EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``MIN_LETTERS`` letters and ``MIN_COUNT`` places, letters deleted by the hash of
    document and word."""
    lower = bytes(LOWER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def send():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), type=pa.string()), pa.array(held.values(), type=pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = raw.as_py()
                if not raw:
                    continue
                low = raw.translate(lower).decode()
                own = Counter(RUN.findall(low) if len(low) < 1 << 20 else (m[0] for m in RUN.finditer(low)))
                start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for word, n in own.items():
                    if start is not None:
                        word = letter_deleted(word, zlib.crc32(word.encode(), start))
                    if len(word) >= MIN_LETTERS:
                        held[word] += n
                if len(held) >= HELD:
                    yield send()
                    held.clear()
        if held:
            yield send()

    return docs.select(key, text).mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Described:
    """Words with their vectors, as counts and as one number whose highest digits are the first levels, and hashes of
    their halves. A word of L letters has halves as one of L and as one that a letter of L - 1 was added to:
    column 0 and 1 of ``halves`` the first and last half of L, column 2 and 3 those of L - 1."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        end = np.cumsum(self.length)
        start = end - self.length
        at = np.repeat(np.arange(len(words)), self.length) * GROUPS + GROUP_OF[letters & 255]
        counts = np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
        self.counts = np.minimum(counts, CAP).astype(np.int8)
        self.code = np.zeros(len(words), dtype=np.int64)
        for level in range(GROUPS):
            self.code = self.code * (CAP + 1) + self.counts[:, level]
        n = len(letters)
        up, down = powers(1 << max(16, int(n).bit_length()))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])

        def half(a, b, length):
            # The length goes into the hash, so that only halves of the same length of word are equal.
            value = (sums[b] - sums[a]) * down[np.minimum(a, len(down) - 1)]
            return mixed(value ^ (length.astype(np.uint64) * FACTOR))

        less = self.length - 1
        self.halves = np.stack([
            half(start, start + self.length // 2, self.length), half(start + self.length // 2, end, self.length),
            half(start, start + less // 2, less), half(end - (less - less // 2), end, less)], axis=1)

    @property
    def node(self) -> np.ndarray:
        return self.code >> (4 * (GROUPS - ROUTED))


def one_apart(a: str, b: str) -> bool:
    """Whether one letter put in, left out or replaced makes ``a`` into ``b``, which differs from it."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def reachable(first: np.ndarray) -> list[np.ndarray]:
    """Nodes at the routed level that a budget of one surplus and one deficit reaches, for each word's first counts:
    arrays with -1 where there is none."""
    shifts = [np.zeros(ROUTED, dtype=np.int64)]
    one = np.eye(ROUTED, dtype=np.int64)
    shifts += [s * one[i] for i in range(ROUTED) for s in (1, -1)]
    shifts += [one[i] - one[j] for i in range(ROUTED) for j in range(ROUTED) if i != j]
    out = []
    for s in shifts:
        to = first + s
        node = np.zeros(len(first), dtype=np.int64)
        for level in range(ROUTED):
            node = node * (CAP + 1) + to[:, level]
        out.append(np.where(((to >= 0) & (to <= CAP)).all(axis=1), node, -1))
    return out


def equal_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] = b[j]."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, side="left"), np.searchsorted(b[order], a, side="right")
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    inner = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return i, order[np.repeat(low, n) + inner]


def trie_search(held: Described, asking: Described) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking word, held word): words whose vectors differ by one surplus and one deficit at most, and one of whose
    halves is equal. ``held`` is in order of its codes, so every node of the trie is a stretch of it."""
    if not len(held.words) or not len(asking.words):
        return
    counts, wanted = held.counts, asking.counts
    stack = [(0, 0, len(held.words), np.arange(len(asking.words)), np.zeros(len(asking.words), dtype=np.int8),
              np.zeros(len(asking.words), dtype=np.int8))]
    found, size = [], 0
    while stack:
        level, low, high, alive, surplus, deficit = stack.pop()
        if level == GROUPS and len(alive) * (high - low) > PAIRS:
            # Many words of one vector: those with an equal half, without comparing all with all.
            mine, theirs = asking.halves[alive], held.halves[low:high]
            met = [equal_pairs(mine[:, a], theirs[:, b]) for a, b in ((0, 0), (1, 1), (2, 0), (3, 1), (0, 2), (1, 3))]
            i, j = (np.concatenate(c) for c in zip(*met, strict=True))
            i, j = np.unique(np.stack([i, j]), axis=1)
            yield alive[i], j + low
            continue
        if level == GROUPS or high - low <= SMALL:
            for at in range(0, len(alive), PAIRS // SMALL // GROUPS):
                some = alive[at : at + PAIRS // SMALL // GROUPS]
                differ = wanted[some][:, None, level:] - counts[None, low:high, level:]
                over = surplus[at : at + len(some), None] + np.maximum(differ, 0).sum(axis=2)
                under = deficit[at : at + len(some), None] + np.maximum(-differ, 0).sum(axis=2)
                i, j = np.nonzero((over <= 1) & (under <= 1))
                found.append((some[i], j + low))
                size += len(i)
            if size >= PAIRS:
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
                found, size = [], 0
            continue
        here = counts[low:high, level]
        turns = [0, *(np.flatnonzero(here[1:] != here[:-1]) + 1).tolist(), high - low]
        ask = wanted[alive, level]
        for a, b in zip(turns[:-1], turns[1:], strict=True):
            differ = ask - here[a]
            over, under = surplus + np.maximum(differ, 0), deficit + np.maximum(-differ, 0)
            go = (over <= 1) & (under <= 1)
            if go.any():
                stack.append((level + 1, low + a, low + b, alive[go], over[go], under[go]))
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def with_equal_half(a: Described, i: np.ndarray, b: Described, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair has equal first halves, equal last halves), as words of the shorter one's length."""
    more = a.length[i] - b.length[j]
    x, y = a.halves[i], b.halves[j]
    first = ((more == 0) & (x[:, 0] == y[:, 0])) | ((more == 1) & (x[:, 2] == y[:, 0])) | ((more == -1) & (x[:, 0] == y[:, 2]))
    last = ((more == 0) & (x[:, 1] == y[:, 1])) | ((more == 1) & (x[:, 3] == y[:, 1])) | ((more == -1) & (x[:, 1] == y[:, 3]))
    return first, last


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def searched(words: list[str], counts: list[int], holds: list[bool], slots: list[int]) -> pa.RecordBatch:
    """What the near pairs of one part of a subtrie add to their words. ``holds`` marks the words of the subtrie; the
    others only search. Where the subtrie is dealt out, ``slots`` says under which of its four halves a word stands here,
    and a pair counts where its first halves meet, or else its last halves."""
    order = sorted(range(len(words)), key=lambda k: (not holds[k], slots[k]))
    words, counts, slots = [words[k] for k in order], [counts[k] for k in order], np.array([slots[k] for k in order])
    n_held = sum(holds)
    if not n_held:
        return pa.RecordBatch.from_pylist([], schema=NEAR)
    every = Described(words)
    by_code = np.argsort(every.code[:n_held], kind="stable")
    order = np.concatenate((by_code, np.arange(n_held, len(words))))
    every = Described([words[k] for k in order])
    counts, slots = [counts[k] for k in order], slots[order]
    held = Described(every.words[:n_held])
    found: dict[int, tuple[int, int, str]] = {}

    def add(k: int, other: int) -> None:
        n, best_n, best = found.get(k, (0, 0, ""))
        m, w = counts[other], every.words[other]
        if m > best_n or (m == best_n and w < best):
            best_n, best = m, w
        found[k] = (n + 1, best_n, best)

    for i, j in trie_search(held, every):
        # Two words of the subtrie find each other twice.
        keep = (i >= n_held) | (i > j)
        i, j = i[keep], j[keep]
        first, last = with_equal_half(every, i, held, j)
        if len(slots) and slots[0] >= 0:
            a, b = slots[i], slots[j]
            more = every.length[i] - held.length[j]
            # Here as words of the shorter one's length, and under the same half.
            as_long = (a < 2) == (more <= 0)
            as_long &= (b < 2) == (more >= 0)
            keep = as_long & (a % 2 == b % 2) & np.where(a % 2 == 0, first, last & ~first)
        else:
            keep = first | last
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if one_apart(every.words[x], every.words[y]):
                add(x, y)
                add(y, x)
    return pa.RecordBatch.from_arrays(
        [pa.array([every.words[k] for k in found], type=pa.string()),
         *[pa.array(c, type=t) for c, t in zip(zip(*found.values(), strict=True), NEAR.types[1:], strict=True)]]
        if found else [pa.array([], type=t) for t in NEAR.types], schema=NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of the table (word, n) are near each, and the most frequent of them (of
    equally frequent ones the first in order of code points); words without any are left out."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = np.unique(Described(batch.column("word").to_pylist()).node, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], ["node", "n"])

    sizes = {r["node"]: r["n"] for r in words.select("word").mapInArrow(placed, "node long, n long").groupBy("node").agg(
        F.sum("n").alias("n")).collect()}
    # Of equally large subtries the words of the one with the smaller number travel.
    size_of = np.zeros((CAP + 1) ** ROUTED, dtype=np.int64)
    size_of[list(sizes)] = list(sizes.values())

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Described(batch.column("word").to_pylist())
            node = own.node
            for k, to in enumerate(reachable(own.counts[:, :ROUTED].astype(np.int64))):
                if k:
                    size, mine = size_of[to], size_of[node]
                    goes = (to >= 0) & (size > 0) & ((size > mine) | ((size == mine) & (to > node)))
                else:
                    goes = np.ones(len(to), dtype=bool)
                blocks = -(-size_of[to] // NODE_WORDS)
                whole = np.flatnonzero(goes & (blocks <= 1))
                yield rows(batch, whole, to, k == 0, np.full(len(whole), -1), np.zeros(len(whole), dtype=np.int64))
                dealt = np.flatnonzero(goes & (blocks > 1))
                for slot in range(4) if len(dealt) else ():
                    part = (own.halves[dealt, slot] % blocks[dealt].astype(np.uint64)).astype(np.int64) * 2 + slot % 2
                    yield rows(batch, dealt, to, k == 0, np.full(len(dealt), slot), part)

    def rows(batch, which, to, holds, slot, part):
        some = batch.take(pa.array(which))
        return pa.RecordBatch.from_arrays(
            [pa.array(to[which]), pa.array(part), some.column("word"), some.column("n"),
             pa.array(np.full(len(which), holds)), pa.array(slot, type=pa.int32())],
            ["node", "part", "word", "n", "holds", "slot"])

    def search(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([searched(*[table.column(c).to_pylist() for c in ("word", "n", "holds", "slot")])])

    found = (
        words.select("word", "n")
        .mapInArrow(routed, "node long, part long, word string, n long, holds boolean, slot int")
        .groupBy("node", "part").applyInArrow(search, "word string, n_near long, best_n long, best string")
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead; words without a form are left out. Forms rise in frequency,
    so there are no rings; each round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while not at.where("open").isEmpty():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "spelling-roots")
    return at.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of a corpus with the spelling that each is a variant of."""
    words = written(counted_words(docs, key, text), "spelling-words")
    near = near_words(words)
    known = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= FORM_RATIO * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= FORM_RATIO * F.col("n"), F.col("best_n")).alias("form_n")), "spelling-forms")
    led = roots(known.where("form is not null"))
    return known.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

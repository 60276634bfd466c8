"""Token ids of whole texts, with the ids of pieces kept from text to text.

White space splits words and the tokenizer's splitting rule splits words into pieces, so a text's ids are those of its
pieces one after the other. The pieces of many texts are found at once, as NumPy arrays over the bytes of the texts, and
each distinct one is looked up once. A word that its bytes alone don't tell how to split (contractions, special tokens,
letters beyond Latin) is one piece there, split when it is first met. The ids of up to ``KEPT`` pieces are kept for the
texts to come.
"""

from __future__ import annotations

import codecs
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from storelens.llm.words import LOWER

KEPT = 400_000

# The splitting rule and byte letters of the tokenizers with word ends.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in set(PRINTED)]
LETTERS = "".join(chr(256 + OTHERS.index(b) if b in OTHERS else b) for b in range(256))
# Python splits words at these, the tokenizer doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")
# Letters below this need no normal form, and only their lower case matters.
PLAIN = 0x250

# What a byte is in a word that is split by its bytes: U+00C0 to U+023F are letters but for those in ODD_PAIRS.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
KIND = np.full(256, LETTER, dtype=np.uint8)
KIND[:128] = [SPACE if chr(b) in "\t\n\v\f\r " else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
              for b in range(128)]
KIND[[*b"'\x1c\x1d\x1e\x1f\xc2", *range(0xC9, 256)]] = ODD
ODD_PAIRS = [b"<|", "×".encode(), "÷".encode(), "İ".encode()]

_encoders: dict[str, Callable[[list[bytes]], list[bytes]]] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, four bytes each."""
    encode = texts_encoder(path)
    return lambda text: encode([text.encode()])[0]


def texts_encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """A function from texts in UTF-8 to the ids of each, four bytes each; one for each worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = _encoder(path)
    return _encoders[path]


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of the texts, A-Z lower, and words with odd bytes whole as they are; text d has those from ``first[d]``
    to ``first[d + 1]``."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    kind = KIND[raw]
    odd = kind == ODD
    for a, b in ODD_PAIRS:
        odd[:-1] |= (raw[:-1] == a) & (raw[1:] == b)
    at = np.flatnonzero(odd)
    if len(at):
        turns = np.flatnonzero(np.diff(kind != SPACE, prepend=False))
        word = np.unique(np.searchsorted(turns[::2], at, side="right") - 1)
        change = np.zeros(len(raw), dtype=np.int8)
        change[turns[::2][word]], change[turns[1::2][word]] = 1, -1
        kind[np.cumsum(change, dtype=np.int8) > 0] = ODD
    starts = (kind != SPACE) & ((np.diff(kind, prepend=SPACE) != 0) | (kind == DIGIT))
    first = np.searchsorted(np.flatnonzero(starts), np.cumsum([0, *(len(x) + 1 for x in texts)])).astype(np.int32)
    keep = kind != SPACE
    data = np.where(kind == ODD, raw, LOWER[raw])[keep]
    offsets = np.append(np.flatnonzero(starts[keep]), len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), first


def _encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    known: dict[bytes, bytes] = {}
    raw = lambda ids: array("I", ids).tobytes()

    def ids_of(piece: bytes) -> bytes:
        w = piece.decode()
        if piece.isalpha():
            letters = [w]
        elif "<|" in w or SEPARATORS.search(w) or ord(max(w)) >= PLAIN:
            # Special tokens and letters with other forms are left to the tokenizer.
            return raw(tokenizer.encode(w, add_special_tokens=False).ids)
        else:
            low = w.lower()
            parts = [low] if low.isalpha() else SPLIT.findall(low)
            letters = [codecs.charmap_decode(p.encode(), "strict", LETTERS)[0] for p in parts]
        return raw([t.id for x in letters for t in model.tokenize(x)])

    def looked_up(distinct: list[bytes]) -> list[bytes]:
        got = list(map(known.get, distinct))
        for i in [i for i, ids in enumerate(got) if ids is None]:
            if len(known) >= KEPT:
                known.clear()
            got[i] = known[distinct[i]] = ids_of(distinct[i])
        return got

    def encode(texts: list[bytes]) -> list[bytes]:
        pieces, first = split(texts)
        coded = pieces.dictionary_encode()
        ids = pa.array(looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        by_text = pa.ListArray.from_arrays(pa.array(first), ids.take(coded.indices))
        return pc.binary_join(by_text, pa.scalar(b"", pa.large_binary())).to_pylist()

    return encode

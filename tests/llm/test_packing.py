import random
import sys
import zlib

import pytest
from tokenizers import Tokenizer

from storelens.llm import packing, tokens
from tests.llm.conftest import prose

PATH = packing.public_tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def raw(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def check(rows, expected):
    """Every id in exactly one piece, sequences gapless and no longer than a window."""
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == expected.keys()
    for doc, ids in expected.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(raw(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    lengths = []
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        lengths.append(at)
    return lengths


def padded(lengths):
    return sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in lengths)


def test_ids_of_the_tokenizer(tokenizer, awkward):
    encode = tokens.encoder(PATH)
    texts = [r.text or "" for r in awkward.select("text").collect()]
    texts += ["İstanbul ΑΣ ΣΑΣ ǅ it's I'LL don't <|startoftext|>x y<|endoftext|> é ﬁ ½ ٣ a b c\x85d ª'S", "x\x1cy z​",
              "a1b22c -- ... !? $5.00", "ſ K Å ß ẞ"]
    for text in texts:
        assert encode(text) == raw(tokenizer.encode(text, add_special_tokens=False).ids), text[:40]


def calls(work):
    """Calls of Python and C functions."""
    count = 0

    def one(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(one)
    try:
        work()
    finally:
        sys.setprofile(None)
    return count


def test_new_words_of_known_pieces(tokenizer):
    """Words never met cost nothing of their own where their pieces were met; before, each was split and looked up."""
    some = [a + b for a in "bcdfglmnpr" for b in "aeiou"]
    text = " ".join(f"{a}{i % 10}{b}{c}" for a in some for i, b in enumerate(some) for c in ",.!-")
    assert len(set(text.split())) == 10_000
    encode = tokens.encoder(PATH)
    encode("first")  # Arrow imports what it needs.
    assert calls(lambda: encode(text)) < 5000
    assert encode(text) == raw(tokenizer.encode(text, add_special_tokens=False).ids)


def test_texts_together(tokenizer):
    draw = random.Random(3)
    odd = ["<|", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "DON'T", "×", "a÷b", "İ", "É", "e\u0301", "\x85", "\xa0", "\x1c", "\u2028",
           "ΣΑΣ", "ª", "ǅ", "Ⱥ", "中", "\U0001f600", " ", "\n", "\t", "1", "22", ".", "--", "the", "The", "x"]
    texts = ["".join(draw.choices(odd, k=draw.randrange(12))) for _ in range(3000)]
    assert "" in texts
    for text, ids in zip(texts, tokens.texts_encoder(PATH)([t.encode() for t in texts]), strict=True):
        assert ids == raw(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_pieces(spark, tokenizer):
    draw = random.Random(1)
    texts = [prose(i, draw.choice([5, 50, 300, 900, 2500])) for i in range(120)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    rows = packing.packed(docs, PATH).collect()
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    lengths = check(rows, expected)
    assert padded(lengths) < 0.03 * sum(lengths)


def test_awkward_rows(spark, tokenizer, awkward, nothing):
    rows = packing.packed(awkward.where("coalesce(doc_id, -1) <> 7"), PATH).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.select("doc_id", "text").collect() if r.doc_id != 7}
    check(rows, {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()})
    twice = packing.packed(awkward.where("doc_id = 7"), PATH).collect()
    assert len([r for r in twice if r.start == 0]) == 2
    assert packing.packed(nothing, PATH).collect() == []


def test_window_slots_and_repacking():
    draw = random.Random(2)
    documents = [(i, raw(range(draw.choice([1, 3, 30, 64, 65, 200])))) for i in range(500)]
    open_pieces, full = [], []
    for is_open, pieces in packing.pack(iter(documents), 64, 4, 0):
        (open_pieces if is_open else full).append(pieces)
    assert len(open_pieces) <= 4
    merged = packing.repack([p[:4] for w in open_pieces for p in w], 64, 10_000)
    total = sum(len(p[2]) // 4 for w in full for p in w) + sum(len(p[2]) // 4 for p in merged)
    assert total == sum(len(r) // 4 for _, r in documents)
    assert all(sum(len(p[2]) // 4 for p in w) <= 64 for w in full)

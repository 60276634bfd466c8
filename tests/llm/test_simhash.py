import random

import numpy as np
import pytest
import xxhash

from storelens.llm import simhash
from tests.llm.conftest import DOCS, plain_words, prose


def plain_print(text):
    words = plain_words(text)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    votes = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def plain_components(ids, prints):
    label = {d: d for d in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, p) in enumerate(zip(ids, prints)):
        for b, q in zip(ids[:i], prints[:i]):
            if (p ^ q).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in ids}


def test_against_plain_version(spark):
    base = prose(5, 300).split()
    texts = [prose(i, 3 * i) for i in range(30)]
    for k in range(60):
        words = list(base)
        words[k] = "changed"
        texts.append(" ".join(words))
    texts += [texts[10]] * 5 + [prose(77, 700), "Tab\tand\x0bline\fbreaks\r\n Here"]
    got = {r.doc_id: r for r in simhash.near_duplicates(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    prints = [plain_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert {i: r.component_id for i, r in got.items()} == plain_components(list(range(len(texts))), prints)


@pytest.mark.parametrize("block, together", [(4, 2), (4096, 512)])
def test_links_connect_all_that_are_near(spark, monkeypatch, block, together):
    """Also where every key is cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    draw = random.Random(3)
    seeds = [draw.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    values = sorted({s ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))) for s in seeds for _ in range(25)})
    signed = [v - (1 << 64) * (v >> 63) for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    from storelens.llm.shared import components

    found = {r.node: r.root for r in components(simhash.links(prints), "test").collect()}
    expected = plain_components(list(range(len(values))), values)
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(found.get(v, v), set()).add(i)
    wanted = {}
    for i, root in expected.items():
        wanted.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_close_pairs_of_all_sizes():
    draw = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 200):
        values = draw.integers(0, 2**64, n, dtype=np.uint64) & np.uint64(0xF00000000000000F)
        got = {(i, int(j)) for i, near in simhash.close_pairs(values) for j in near}
        assert got == {(i, j) for i in range(n) for j in range(i) if np.bitwise_count(values[i] ^ values[j]) <= 2}


def test_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == awkward.count() and len(by[7]) == 2
    assert {by[i][0].fingerprint for i in (0, 1, 2)} == {"0" * 16}
    assert by[2][0].component_id == 0 and by[8][0].component_id == 7
    assert by[None][0].fingerprint == f"{plain_print('no id at all here'):016x}" and by[None][0].component_id is None


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []

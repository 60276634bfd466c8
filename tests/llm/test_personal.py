import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.llm import personal
from storelens.llm.registered import QUERIES
from tests.llm.conftest import DOCS, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plainly(text):
    """Base spans by the patterns as they are given."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            if (kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                    or (kind == "card" and 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0)
                    or (kind == "phone" and 8 <= len(digits) <= 15)):
                out.append((kind, *m.span()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def base_of(text):
    return [(personal.KINDS[k], a, b) for k, a, b, good in sorted(personal.base_matches(text)) if good]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.-+%_ 0159()é[]:\n", max_size=60))
def test_base_spans_of_odd_texts(text):
    assert base_of(text) == plainly(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "5500 0055 5555 5559", " ", "-", ".", "+1 (017) 555-7713", "+", "1.2.3.4", "255.256",
                                 "0", "a@b.c", "@", "é", "9" * 19, "79927398713"]), max_size=12).map("".join))
def test_base_spans_of_made_up_data(text):
    assert base_of(text) == plainly(text)


def test_time_grows_with_the_text():
    for unit in ("a", "1", "@", "a@", "+", "+1", "(", "1.", "1 ", "é1", "a@b", " at a", "+1 (", "a.", "1[.]", "::1", "(at)a"):
        took = []
        for n in (100_000, 400_000):
            text = (unit * n)[:n]
            began = time.process_time()
            strictly = personal.base_matches(text)
            list(personal.loose_matches(text))
            took.append(time.process_time() - began)
            assert len(strictly) <= n
        assert took[1] < 8 * took[0] + 0.2, unit


def plant(seed, n=160):
    """Texts with personal data in context, in strict and loose forms, and with what only looks like it."""
    draw = random.Random(seed)
    texts, planted = [], []

    def digits(k):
        return "".join(draw.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + digits(14)
        return next(body + d for d in "0123456789" if personal.luhn(body + d))

    for i in range(n):
        forms = {
            "mail me at": (f"user{i}@mail{i % 9}.example.com", "email"), "call phone": (f"+1 ({draw.randrange(200, 999)}) 555-{digits(4)}", "phone"),
            "visa card": (card(), "card"), "server ip": (f"{draw.randrange(1, 255)}.{draw.randrange(256)}.{draw.randrange(256)}.7", "ip"),
        }
        loose = {
            "mail contact": (f"jo{i} (at) example (dot) org", "email"), "call phone": (f"(0{draw.randrange(200, 999)}) 555-{digits(4)}", "phone"),
            "credit card": ("37" + digits(12), "card"), "host ip": (f"10[.]1[.]{i % 200}[.]9", "ip"),
        }
        body = loose["credit card"][0]
        loose["credit card"] = (next(body + d for d in "0123456789" if personal.luhn(body + d)), "card")
        parts, at, spans = [], 0, []
        for lead, (value, kind) in [*forms.items(), *(loose.items() if i % 2 else [])]:
            part = f"{prose(seed + i, 5)} {lead}: {value} "
            spans.append((kind, at + part.index(value), at + part.index(value) + len(value)))
            parts.append(part)
            at += len(part)
        tail = f"order {digits(11)}, section {i % 9}.{i % 7}.{i % 5}, look at the dot on it, 1{digits(3)}-{i % 90 + 10}"
        texts.append("".join(parts) + tail)
        planted.append(spans)
    return texts, planted


def test_loose_forms_are_added(spark):
    texts, planted = plant(5)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal.personal_data(docs).collect()}
    wanted = {(i, *s) for i, spans in enumerate(planted) for s in spans}
    got = {(i, *s) for i, spans in found.items() for s in spans}
    base = {(i, *s) for i, t in enumerate(texts) for s in plainly(t)}
    assert base <= got
    assert len(wanted & got) >= 0.95 * len(wanted)
    assert len(got - base - wanted) <= 0.02 * len(got)


def test_nothing_is_added_to_plain_texts(spark):
    texts = [prose(i, 80) + f" meet at the dot on page {i}, 12 by {i} in 19{i % 90 + 10}-05-17, version 1.2.{i}" for i in range(60)]
    texts += plant(5, 40)[0]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    assert all(not r.spans for r in personal.personal_data(docs).where("doc_id < 60").collect())


def test_whole_table_as_registered(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_weak_supervision_pii"](spark, data).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        base, r = plainly(text), got[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(",")) or not base
        assert r.spans or not base


def test_same_answers_however_rows_are_dealt(spark):
    texts, _ = plant(8, 60)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    one = personal.summary(personal.personal_data(docs.coalesce(1))).collect()
    assert sorted(one) == sorted(personal.summary(personal.personal_data(docs.repartition(7))).collect())


def test_odd_rows(spark, awkward, nothing):
    out = personal.summary(personal.personal_data(awkward))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = out.collect()
    assert len(rows) == awkward.count() and {r.spans for r in rows} == {""}
    assert personal.personal_data(nothing).collect() == []
    texts = ["x@y.zz " * 2, None, "\U0001f600 x@y.zz", "x@y.zz " * 2, "1.2.3.4 " + prose(1, 60_000) + " a@b.de"]
    docs = spark.createDataFrame([(None if i == 1 else i % 3, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    got = sorted((r.spans for r in personal.summary(personal.personal_data(docs)).collect()), key=len)
    assert got[:2] == ["", "email:2:8"] and got[2] == got[3] == "email:0:6,email:7:13" and got[4].endswith(",ip:0:7")


def test_likelihoods_find_the_labelers_that_are_right():
    draw = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.6])
    real = draw.random(6000) < 0.4
    votes = np.where(draw.random((6000, 6)) < right, 1, -1) * np.where(real, 1, -1)[:, None]
    votes[draw.random((6000, 6)) < 0.3] = 0
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    likely, tables, share = personal.likelihoods(patterns, n.astype(float))
    assert abs(share - 0.4) < 0.03
    said = (tables[1, :, 2] / (tables[1, :, 2] + tables[1, :, 0]))
    assert np.abs(said - right).max() < 0.05
    by_pattern = {tuple(p): q for p, q in zip(patterns.tolist(), likely.tolist(), strict=True)}
    guessed = np.array([by_pattern[tuple(v)] > 0.5 for v in votes.tolist()])
    majority = votes.sum(axis=1) > 0
    assert (guessed == real).mean() > max(0.93, (majority == real).mean())


def test_patterns_keep_votes():
    text = "call phone: (0555) 123-4567 or mail a@b.de"
    (kind, a, b, pattern, form, good), = [c for c in personal.encoded(text, sorted(personal.loose_matches(text)))]
    votes, f, separators = personal.decoded(pattern)
    assert (text[a:b], kind, form, f, good, separators) == ("(0555) 123-4567", personal.PHONE, 7, 7, True, 1)
    assert dict(zip(personal.LABELERS, votes, strict=True))["for"] == 1

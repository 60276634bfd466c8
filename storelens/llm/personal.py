"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the votes, and a
classifier learnt from the weighed votes decides.

Candidates are the matches of the base patterns, those that fail their test included, and looser forms: addresses with
the sign written out, numbers of version 6 and with bracketed dots, card numbers and phones inside longer rows of digits, phones without a
country. Eight labelers look at each candidate and vote for, against or not at all: two patterns (the strict form with
its test, the usual grouping), gazetteers (top domains, issuers, calling codes, address blocks), context words for and
against, the signs on both sides, rows of digits that no one has, and other personal data near by.

Votes are all that matters to the next step, so Spark counts the patterns of votes. Their number doesn't grow with the
corpus (three votes of eight labelers and sixteen forms for each kind), and the counts go to the driver: expectation-maximisation
over them estimates how often each labeler says what of real and of false candidates, and with that how likely each
pattern is real. A logistic regression over votes, form and separators is fitted to these likelihoods, all candidates
weighing in. Spans of loose candidates that hold their kind's own test (Luhn, 255, digits, a top domain) are added where
the classifier gives ``SURE`` or more, best first, none over another span. Base spans always stay.

Defined results: no text counts as empty; repeated rows and rows without an id come out as they went in; other columns
are left out; an empty table gives an empty result, and a corpus without candidates adds none. Texts of any length are
read whole, in time that grows with their length; offsets are code points, the end not included.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import written

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
SURE = 0.5
# Code points before and after a candidate whose words count as its context, and within which others are near by.
BEFORE, AFTER, NEAR_BY = 40, 20, 200

# --- base patterns ---
# What the base patterns accept.
MOST_PART, CARD_DIGITS, PHONE_DIGITS = 255, (16, 19), (8, 15)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, the sign and a domain. Found from the signs, as no local part holds one."""
    sign, low = text.find("@"), 0
    while sign >= 0:
        before = text[low:sign]
        local = len(before) - len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, sign + 1) if local else None
        if domain:
            yield sign - local, domain.end()
        low = max(domain.end() if domain else 0, sign + 1)
        sign = text.find("@", low)


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Each four parts in a row of dotted numbers, and whether all are at most 255."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p) <= MOST_PART for p in four)
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its test) of all matches of the base patterns."""
    out = [(EMAIL, a, b, True) for a, b in emails(text)]
    if not ANY_DIGIT.search(text):
        return out
    out += [(IP, a, b, good) for a, b, good in addresses(text)]
    for m in DIGITS.finditer(text):
        n = m.end() - m.start()
        # Longer than digits with a sign between any two can be: no card, whatever the digits.
        digits = only_digits(m[0]) if CARD_DIGITS[0] <= n < 2 * CARD_DIGITS[1] else ""
        if n >= CARD_DIGITS[0]:
            out.append((CARD, *m.span(), CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)))
    for m in DIALLED.finditer(text):
        digits = sum("0" <= c <= "9" for c in m[0])
        out.append((PHONE, *m.span(), PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]))
    return out


# --- looser forms ---
AT_WORD = re.compile(r"\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT|@)\s")
DOT_WORD = r"(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)"
SPELT_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT_WORD}[A-Za-z0-9-]{{1,63}}){{1,5}}")
LOOSE = [
    # (form, kind, pattern); every repetition is bounded, so time grows with the text alone.
    (2, IP, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (3, IP, re.compile(r"(?<![0-9.\]])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.\[])")),
    (4, CARD, re.compile(r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])")),
    (5, CARD, re.compile(r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])")),
    (6, PHONE, re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    (7, PHONE, re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ ./-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])")),
    (8, PHONE, re.compile(r"(?<![0-9A-Za-z.+-])00[1-9][0-9]{0,2}[ .-][0-9]{2,4}[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])")),
]
STRICT, SPELT = 0, 1

# Gazetteers.
TOP_DOMAINS = frozenset("""com org net edu gov int mil info biz name io co me tv app dev de at ch fr be es mx ar cl pt br it
nl uk us ca au nz ie se no fi dk pl cz ru cn jp kr in za eu test example local""".split())
CALLING_CODES = frozenset("""1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62
63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380
385 386 420 421 423 593 595 598 852 886 966 971 972""".split())
WORDS = {
    EMAIL: "mail email contact write reach kontakt schreiben courriel correo contacto electrónico envoyer",
    IP: "ip ipv address addr host hostname server login client ping gateway dns adresse rechner serveur dirección servidor",
    CARD: "card visa mastercard amex maestro credit debit payment paid karte kreditkarte kartennummer carte bancaire tarjeta crédito pago",
    PHONE: "phone telephone tel call fax mobile cell dial whatsapp telefon handy rufnummer anruf téléphone appel appeler teléfono móvil llame llamar",
}
WORDS = {kind: frozenset(words.split()) for kind, words in WORDS.items()}
AGAINST = frozenset("""version release section chapter page isbn issn order invoice token hash sha md id serial part figure table
price article license licensed seite kapitel abschnitt rechnung página capítulo artículo factura pedido chapitre commande""".split())
WORD = re.compile(r"[^\W\d_]+")


def spelt_emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Addresses with the sign written out, and whether the last part of the domain is a top domain."""
    for m in AT_WORD.finditer(text):
        before = text[max(0, m.start() - 64) : m.start()]
        local = len(before) - len(before.rstrip(LOCAL))
        domain = SPELT_DOMAIN.match(text, m.end()) if local else None
        if not domain:
            continue
        # A bare "at" is a word like any other unless the dots are written out too.
        if m[0].strip() in ("at", "AT") and re.search(DOT_WORD.removesuffix(r"|\.)") + ")", domain[0]) is None:
            continue
        top = re.split(r"[^A-Za-z0-9-]+", domain[0])[-1].lower()
        yield m.start() - local, domain.end(), top in TOP_DOMAINS


def loose_matches(text: str) -> Iterator[tuple[int, int, int, int, bool]]:
    """(form, kind, start, end, holds the test of its kind) of the looser forms."""
    for a, b, good in spelt_emails(text):
        yield SPELT, EMAIL, a, b, good
    if not ANY_DIGIT.search(text):
        return
    for form, kind, pattern in LOOSE:
        for m in pattern.finditer(text):
            digits = only_digits(m[0])
            if kind == CARD:
                good = luhn(digits) and bool(issuer(digits))
            elif kind == PHONE:
                good = 7 <= len(digits) <= PHONE_DIGITS[1]
            else:
                good = form == 2 or all(int(p) <= MOST_PART for p in m[0].split("[.]"))
            yield form, kind, *m.span(), good


def issuer(digits: str) -> str:
    two, four = int(digits[:2]), int(digits[:4])
    if digits[0] == "4":
        return "visa"
    if 51 <= two <= 55 or 2221 <= four <= 2720:
        return "mastercard"
    if two in (34, 37):
        return "amex"
    return "other" if two in (35, 36, 38, 62, 65) or four == 6011 else ""


# --- labelers ---

LABELERS = ["strict", "grouping", "gazetteer", "for", "against", "sides", "rows", "company"]


def strict(kind: int, form: int, span: str, good: bool) -> int:
    return 0 if form else 1 if good else -1


def grouping(kind: int, form: int, span: str, digits: str) -> int:
    """The usual way to write such data."""
    if kind == EMAIL:
        top = re.split(r"[^A-Za-z0-9]+", span)[-1]
        return 1 if top.isalpha() and len(top) >= 2 else -1
    if kind == IP:
        parts = span.split(".")
        return 0 if form else 1 if all(p == "0" or not p.startswith("0") for p in parts) else -1
    if kind == CARD:
        groups = [len(g) for g in re.split("[ -]", span)]
        return 1 if groups in ([len(digits)], [4, 4, 4, 4], [4, 6, 5]) else -1
    groups = [len(g) for g in re.split(r"[ ().-]+", span.strip("+() ")) if g]
    return 1 if 2 <= len(groups) <= 5 and groups[-1] >= 2 else 0 if len(groups) == 1 else -1


def gazetteer(kind: int, form: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z0-9-]+", span)[-1].lower() in TOP_DOMAINS else -1
    if kind == IP:
        first = int(span.split(".")[0][:4]) if not form else 1
        return 1 if 1 <= first <= 255 else -1
    if kind == CARD:
        return 1 if len(digits) > 11 and issuer(digits) else 0
    if form in (STRICT, 6, 8):
        code = digits[2:] if form == 8 else digits
        return 1 if any(code[:k] in CALLING_CODES for k in (1, 2, 3)) else -1
    return 0


def rows_of_digits(kind: int, digits: str) -> int:
    """Digits all alike, or each one more than the last: samples, not data."""
    if kind in (EMAIL, IP) or len(digits) < 8:
        return 0
    alike = max(map(digits.count, "0123456789")) > 0.7 * len(digits)
    rising = sum((int(b) - int(a)) % 10 == 1 for a, b in zip(digits, digits[1:], strict=False)) > 0.7 * len(digits)
    return -1 if alike or rising else 0


def encoded(text: str, found: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, int, int, int, bool]]:
    """(kind, start, end, pattern, form, holds its test) of candidates (form, kind, start, end, holds its test): the pattern is the votes as
    digits of base 3, then the form, then one bit for separators within."""
    starts = sorted(a for f, _, a, _, good in found if good and not f)
    out = []
    for form, kind, a, b, good in found:
        span = text[a : min(b, a + 400)]
        digits = only_digits(span)
        before = [w.lower() for w in WORD.findall(text[max(0, a - BEFORE) : a])]
        around = {*before, *(w.lower() for w in WORD.findall(text[b : b + AFTER]))}
        left, right = text[a - 1 : a], text[b : b + 1]
        closed = not (left.isalnum() or right.isalnum() or left in ("_", "=", "#", "/") or right in ("_", "=", "@"))
        low, high = bisect.bisect_left(starts, a - NEAR_BY), bisect.bisect_right(starts, b + NEAR_BY)
        near = high - low - (good and not form)
        votes = [
            strict(kind, form, span, good), grouping(kind, form, span, digits), gazetteer(kind, form, span, digits),
            int(not around.isdisjoint(WORDS[kind])), -int(not AGAINST.isdisjoint(before)), 1 if closed else -1,
            rows_of_digits(kind, digits), int(near > 0),
        ]
        pattern = 0
        for v in votes:
            pattern = pattern * 3 + v + 1
        pattern = (pattern * 16 + form) * 2 + int(" " in span or "-" in span)
        out.append((kind, a, b, pattern, form, good))
    return out


def decoded(pattern: int) -> tuple[list[int], int, int]:
    """(votes, form, separators) of a pattern."""
    pattern, separators = divmod(pattern, 2)
    pattern, form = divmod(pattern, 16)
    votes = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        votes.append(v - 1)
    return votes[::-1], form, separators


SCANNED = "base array<struct<kind: int, start: int, end: int>>, candidates array<struct<kind: int, start: int, end: int, pattern: int, form: int, good: boolean>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, candidates): the base spans and all candidates of each text, with their votes."""
    spans = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")]))
    voted = pa.list_(pa.struct([*[(c, pa.int32()) for c in ("kind", "start", "end", "pattern", "form")], ("good", pa.bool_())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, candidates = [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                strictly = base_matches(t)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b, good in sorted(strictly) if good])
                there = {(k, a, b) for k, a, b, _ in strictly}
                found = [(STRICT, k, a, b, good) for k, a, b, good in strictly]
                found += sorted({f for f in loose_matches(t) if f[1:4] not in there})
                candidates.append([dict(zip(("kind", "start", "end", "pattern", "form", "good"), c, strict=True))
                                   for c in encoded(t, found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, type=spans), pa.array(candidates, type=voted)], ["doc_id", "base", "candidates"])

    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(each, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {SCANNED}")


# --- model ---

# Votes that each labeler is taken to have cast before any is counted: right rather than wrong.
TRUST = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
RIDGE = 1.0


def likelihoods(votes: np.ndarray, n: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """(how likely each pattern of votes is real, what real (1) and false (0) candidates get voted by each labeler, share
    of real ones), by expectation-maximisation over ``n`` candidates of each pattern."""
    real = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    tables, share = np.zeros((2, votes.shape[1], 3)), 0.5
    one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        for y, p in ((0, 1 - real), (1, real)):
            counts = np.tensordot(n * p, one, axes=1) + TRUST[y]
            tables[y] = counts / counts.sum(axis=1, keepdims=True)
        share = (float(n @ real) + 1) / (float(n.sum()) + 2)
        odds = np.log(share) - np.log1p(-share) + np.tensordot(one, np.log(tables[1]) - np.log(tables[0]), axes=2)
        now = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(now - real).max() < 1e-10
        real = now
        if done:
            break
    return real, tables, share


def features(patterns: list[int]) -> np.ndarray:
    """What the classifier sees of each pattern: each vote for and against, the form and the separators."""
    rows = []
    for pattern in patterns:
        votes, form, separators = decoded(pattern)
        rows.append([1.0, *[float(v > 0) for v in votes], *[float(v < 0) for v in votes], float(separators),
                     *[float(form == f) for f in range(9)]])
    return np.array(rows)


def logistic(x: np.ndarray, real: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression on likelihoods, by Newton's steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * (real - p)) - ridge * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        # Steps of a bounded length keep the first ones from running away.
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fitted(scanned: DataFrame) -> dict[int, dict[int, float]]:
    """The classifier's score of each pattern of each kind."""
    counted = scanned.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.pattern").count()
    by_kind: dict[int, dict[int, int]] = {}
    for r in counted.collect():
        by_kind.setdefault(r["kind"], {})[r["pattern"]] = r["count"]
    scores = {}
    for kind, counts in by_kind.items():
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], dtype=float)
        votes = np.array([decoded(p)[0] for p in patterns])
        real, _, _ = likelihoods(votes, n)
        x = features(patterns)
        score = 1 / (1 + np.exp(-np.clip(x @ logistic(x, real, n), -500, 500)))
        scores[kind] = dict(zip(patterns, score.tolist(), strict=True))
    return scores


def chosen(base: list[dict], candidates: list[dict], scores: dict[int, dict[int, float]],
           sure: float) -> list[tuple[int, int, int, bool, float]]:
    """(kind, start, end, base, score): the base spans, and loose candidates that are sure enough and lie over no other."""
    score = lambda c: scores[c["kind"]][c["pattern"]]
    own = {(c["kind"], c["start"], c["end"]): score(c) for c in candidates if not c["form"]}
    out = [(s["kind"], s["start"], s["end"], True, own[s["kind"], s["start"], s["end"]]) for s in base]
    loose = [c for c in candidates if c["form"] and c["good"] and score(c) >= sure]
    if not loose:
        return sorted(out)
    # Base spans of different kinds may lie over one another: starts with the furthest end so far.
    taken = sorted((s["start"], s["end"]) for s in base)
    low, reach = [a for a, _ in taken], list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    added: list[tuple[int, int]] = []
    for c in sorted(loose, key=lambda c: (-score(c), c["start"] - c["end"], c["start"], c["kind"])):
        a, b = c["start"], c["end"]
        k = bisect.bisect_left(low, b) - 1
        if k >= 0 and reach[k] > a:
            continue
        at = bisect.bisect_left(added, (a, b))
        if (at < len(added) and added[at][0] < b) or (at and added[at - 1][1] > a):
            continue
        added.insert(at, (a, b))
        out.append((c["kind"], a, b, False, score(c)))
    return sorted(out)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """(doc_id, spans): the spans of each text in order of kind and start, base ones and those of the method, with the
    classifier's score."""
    scanned = written(scan(docs, key, text), "personal-scanned")
    scores = fitted(scanned)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                               ("score", pa.float64())]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": own, "score": p} for k, a, b, own, p in chosen(base, found, scores, sure)]
                for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=kind)], ["doc_id", "spans"])

    return scanned.mapInArrow(
        choose, f"doc_id {scanned.schema['doc_id'].dataType.simpleString()}, "
        "spans array<struct<kind: string, start: long, end: long, base: boolean, score: double>>")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each text."""
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[of(kind) for kind in KINDS],
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )

import pytest

from storelens.llm import templates
from tests.llm.conftest import prose

ITEMS = "item_id long, text string, doc_id int"
DOCS = "doc_id long, text string, item_id int, run int"
QUESTION = "If {a} has {x} apples and gives {y} apples to {b}, how many apples does {c} have left after {n} {u}?"


def ask(a="Alice", b="Bob", c=None, x="12", y="5", n="3", u="days"):
    return QUESTION.format(a=a, b=b, c=c or a, x=x, y=y, n=n, u=u)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ask(), 0), (2, "too short", 0), (3, prose(5, 40), 0), (3, prose(5, 40), 0), (None, prose(6, 40), 0), (4, None, 0),
            (5, "1 2 3 4 5 6 7 8 9", 0)]
    return spark.createDataFrame(rows, ITEMS)


def test_templates(spark, items):
    lead, end = prose(1, 30) + ". ", " " + prose(2, 30)
    texts = {
        1: lead + ask() + end, 2: lead + ask("Carol", "Dave", x="70", y="2,5", n="9", u="weeks") + end,
        # Fillings that fit no single exchange of names and numbers.
        3: lead + ask("Carol", "Dave", "Erin", x="7", y="7") .replace("apples does", "pears does") + end,
        4: lead + prose(5, 40) + end, 5: lead + prose(5, 40).upper() + end, 6: lead + " ".join(prose(5, 40).split()[:20]) + end,
        7: "11 12 13 14 15 16 17 18 19", 8: None, 9: "", 10: prose(3, 5000), 12: (prose(5, 40) + " ") * 50,
        13: ask("Carol", "Alice", "Alice", x="5", y="12"), 14: lead + ask(u="dollars") + " And " + ask("Zoe", "Yan", x="1", y="2"),
    }
    rows = [(i, t, 9, 9) for i, t in texts.items()] + [(None, ask(), 9, 9), (1, texts[1], 9, 9)]
    found = {(r.doc_id, r.item_id): r for r in templates.contaminated(spark.createDataFrame(rows, DOCS), items).collect()}
    assert found.keys() == {(1, 1), (2, 1), (4, 3), (5, 3), (12, 3), (13, 1), (14, 1)}
    assert found[2, 1].changed and not found[1, 1].changed and found[4, 3].contained == 1


def test_by_shuffle_as_by_broadcast(spark, items, monkeypatch):
    rows = spark.createDataFrame([(i, prose(100 + i, 50) + " " + (ask() if i % 3 else prose(5, 40)), 1, 1) for i in range(30)], DOCS)
    a = templates.contaminated(rows, items).collect()
    monkeypatch.setattr(templates, "BROADCAST_RUNS", 0)
    assert len(a) == 30 and sorted(a) == sorted(templates.contaminated(rows, items).collect())


def test_empty_tables(spark, items, awkward, nothing):
    assert templates.contaminated(nothing, items).collect() == []
    assert templates.contaminated(awkward, items.limit(0)).collect() == []
    kept = templates.decontaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_no_python_in_the_plan(spark, items, awkward):
    plan = templates.contaminated(awkward, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_capitals_at_sentence_starts(spark):
    items = spark.createDataFrame([
        (1, "What is the capital of France?", 0),
        (2, "Alice bought seven red apples. Bob sold nine green pears. Alice was glad about it.", 0)], ITEMS)
    texts = {
        1: "Question: What is the capital of France?", 2: "1) What is the capital of France? Answer", 3: "what is the capital of France?",
        4: "Carol bought seven red apples. Dave sold nine green pears. Carol was glad about it.",
        5: "Then Carol bought seven red apples. Dave sold nine green pears. Carol was glad about it.",
        6: "What is the colour of France?", 7: prose(1, 30) + ". Alice was glad about it.",
    }
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in texts.items()], DOCS)
    found = {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items).collect()}
    assert found.keys() == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}
    assert [found[d, i].changed for d, i in sorted(found)] == [False, False, False, True, True]
    assert all(r.contained == 1 for r in found.values())


def test_items_that_are_no_templates(spark):
    rows = [(1, "Yes indeed", 0), (2, "12 + 30 * 4 - 7 = ?", 0), (3, "Paris", 0), (4, "...", 0), (5, "", 0), (6, "1 2 3 4 5 6 7 8 9", 0)]
    items = spark.createDataFrame(rows, ITEMS)
    texts = {
        1: prose(1, 20) + " Yes, INDEED! " + prose(2, 20), 2: "so 12 + 30 * 4 - 7 = ? and", 3: "12 + 31 * 4 - 7 = ?", 4: "yes",
        5: "he went to paris.", 6: "0 1 2 3 4 5 6 7 8 9 10", 7: "1 2 3 4 9 5 6 7 8",
    }
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in texts.items()], DOCS)
    found = {(r.doc_id, r.item_id, r.changed) for r in templates.contaminated(docs, items).collect()}
    # The sum is a template: other numbers make it the same question.
    assert found == {(1, 1, False), (2, 2, False), (3, 2, True), (5, 3, False), (6, 6, False)}


def test_sentence_starts_in_copies(spark):
    items = spark.createDataFrame([(1, "how many of the red apples are left? then count the green ones too.", 0)], ITEMS)
    texts = ["How many of the red apples are left? Then count the green ones too.", "how many of the red apples are left? then count the green ones too"]
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in enumerate(texts)], DOCS)
    assert {(r.doc_id, r.contained, r.changed) for r in templates.contaminated(docs, items).collect()} == {(0, 1.0, False), (1, 1.0, False)}


def plain_template(texts, items):
    """Contaminated (document, item) pairs by trying every place, word by word; texts without repeated ids."""
    import itertools
    import re

    def split(text):
        return [w for w in re.split(templates.BREAKS, text or "") if w]

    low = lambda w: w.rstrip(templates.CLOSING).lower()
    number = lambda w: w.lstrip(templates.SIGNS)[:1].isdigit()
    capital = lambda w: w[0] != w[0].lower() and low(w) != w and w.upper() != w

    def form(words, i):
        w = words[i]
        if number(w):
            return "#"
        if i and number(words[i - 1]) and low(w) in templates.UNITS:
            return "%"
        return "@" if capital(w) else low(w)

    out = set()
    for (d, text), (i, item) in itertools.product(texts.items(), items.items()):
        words, theirs = split(text), split(item)
        mine = [form(words, k) for k in range(len(words))]
        wanted = [form(theirs, k) for k in range(len(theirs))]
        either = [(k == 0 or theirs[k - 1].rstrip(templates.CLOSING) != theirs[k - 1]) and wanted[k] not in "#%" for k in range(len(theirs))]
        runs, held = set(), set()
        for p in range(len(theirs) - 4):
            if sum(w not in "#%@" or e for w, e in zip(wanted[p : p + 5], either[p : p + 5])) >= 2:
                runs.add(p)
        for shift in range(-len(theirs), len(words)):
            met, fill = set(), {}
            for p in runs:
                if 0 <= p + shift <= len(words) - 5 and all(
                        m == w or (e and m in ("@", low(t))) for m, w, e, t in zip(
                            mine[p + shift : p + shift + 5], wanted[p : p + 5], either[p : p + 5], theirs[p : p + 5])):
                    ordinary = sum(m not in ("#", "%", "@") for m in mine[p + shift : p + shift + 5])
                    if ordinary >= 2:
                        met.add(p)
                        for k in range(p, p + 5):
                            if mine[k + shift] in ("#", "%", "@"):
                                fill.setdefault(low(theirs[k]), set()).add(low(words[k + shift]))
            if met and (not fill or sum(len(v) == 1 for v in fill.values()) >= 0.8 * len(fill)):
                held |= met
        if runs and len(held) >= 0.8 * len(runs):
            out.add((d, i))
    return out


def test_as_the_plain_version(spark):
    import random

    draw = random.Random(6)
    names = ["Alice", "Bob", "Carol", "Dave"]
    items = {k: f"{draw.choice(names)} has {draw.randrange(99)} {draw.choice(['km', 'apples', 'kg'])} of {prose(k, 5)}. {prose(k + 50, 4).capitalize()} "
                f"and {draw.choice(names)} gives {draw.randrange(99)} to {draw.choice(names)}?" for k in range(8)}

    def changed(text):
        for a in names:
            if draw.random() < 0.4:
                text = text.replace(a, draw.choice(["Erin", "Finn", "Bob"]))
        return " ".join(str(draw.randrange(99)) if w.isdigit() and draw.random() < 0.5 else w if draw.random() < 0.97 else "other" for w in text.split())

    texts = {d: f"{prose(200 + d, 12)}{draw.choice(['.', ' :', ''])} {changed(items[d % 8])} {prose(300 + d, 9)}" for d in range(80)}
    docs = spark.createDataFrame([(d, t, 9, 9) for d, t in texts.items()], DOCS)
    found = {(r.doc_id, r.item_id) for r in templates.contaminated(docs, spark.createDataFrame([(i, t, 0) for i, t in items.items()], ITEMS)).collect()}
    want = plain_template(texts, items)
    assert found == want and 20 < len(want) < 80

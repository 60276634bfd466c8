import re

from storelens.llm import license_rules, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License.", "UNDER--the\nmit\tlicense, under the mit license under the mit", "xunder the mit license",
    "under the mit licensed", "Apache License, Version 2.0 and apache license version 2", "cc by nc cc-BY-nc-4.0 ccc by nc", "",
    "éunder the mit license", "under the mit licenseé", "under the mit·license", "cc by cc by nc by nc", None,
    "a under the mit license " * 300,
]


def test_base_against_plain_version(spark, awkward):
    rows = licenses.summary(licenses.scan_licenses(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    odd = licenses.summary(licenses.scan_licenses(awkward)).collect()
    assert len(odd) == awkward.count()
    texts = {x.doc_id: x.text for x in awkward.select("doc_id", "text").collect()}
    assert all(r.n_words == plain(texts[r.doc_id])[0] for r in odd)


def test_hundreds_of_rules_hold_their_keyword():
    found = license_rules.rules()
    assert len(found) >= 300 and [r.priority for r in found] == sorted(r.priority for r in found)
    samples = {
        b"spdx-license-identifier: gpl-3.0-or-later": "gpl-3", b"http://www.apache.org/licenses/license-2.0": "apache-2",
        b"licensed under the gnu general public license, version 3": "gpl-3", b"bsd 3-clause license": "bsd-3",
        b"creative commons attribution-sharealike 4.0 international": "cc-by-sa-4.0", b"cc by-nc 4.0": "cc-by-nc-4.0",
        b"redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        b"released under the mit license": "mit", b"mozilla public license, version 2.0": "mpl-2",
    }
    for text, label in samples.items():
        hits = []
        for i, r in enumerate(found):
            for m in r.pattern.finditer(text):
                assert any(k in text for k in r.keywords), (r.label, text)
                hits.append((*m.span(), r.priority, i))
        assert [found[h[3]].label for h in licenses.surviving(hits)] == [label], text


def test_containment_suppression():
    # (start, end, priority, rule)
    assert licenses.surviving([(0, 10, 3, 1), (2, 5, 3, 2), (2, 5, 1, 3), (8, 14, 4, 4)]) == [
        (0, 10, 3, 1), (2, 5, 1, 3), (8, 14, 4, 4)]
    assert licenses.surviving([(0, 4, 2, 5), (0, 4, 2, 7), (0, 4, 3, 1)]) == [(0, 4, 2, 5)]


def test_empty_table(nothing):
    assert licenses.summary(licenses.scan_licenses(nothing)).collect() == []


def test_gaps_of_any_length():
    found = license_rules.rules()
    wrapped = (b"redistribution and use in source and binary forms, with or\n" + b" " * 40 + b" *" + b" " * 40
               + b"without modification, are permitted")
    far = b"released under the" + b"\n" * 100_000 + b"mit license"
    for text, label in ((wrapped, "bsd"), (far, "mit")):
        hits = [(*m.span(), r.priority, i) for i, r in enumerate(found) for m in r.pattern.finditer(text)]
        assert [found[h[3]].label for h in licenses.surviving(hits)] == [label]

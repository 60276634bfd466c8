from pyspark.sql import functions as F

from storelens.llm import languages

EN = "the cat and the dog went with them to the house of the other man and that was what they had there"
FR = "le chat et le chien vont avec eux dans la maison de cet autre homme et ceci est pour une fois que nous avons"
ROWS = "id long, kind string, text string, is_html boolean, url string, host string"


def page(lang, text, head=""):
    return f'<!DOCTYPE html><html lang="{lang}"><head>{head}<script>var the="<p>the the the</p>";</script></head><body><p>{text}</p></body>'


def found(spark, rows):
    labelled = spark.createDataFrame([(EN, "en"), (FR, "fr"), (EN + " there", "en"), (None, "fr"), (EN, None)], "text string, lang string")
    return {r.id: r for r in languages.identify(spark.createDataFrame(rows, ROWS), labelled).collect()}


def test_evidence_is_fused(spark):
    rows = [(i, "page", page("en", EN[i : i + 60]), True, f"http://a.example.com/{i}", None) for i in range(40)]
    rows += [(100 + i, "page", page("fr", FR[i : i + 60]), True, f"https://b.exemple.fr/{i}", None) for i in range(40)]
    # No text, so the other sources decide: markup, address, host.
    rows += [(200, "page", page("fr", ""), True, "http://new.org/", None), (201, "page", "", True, "http://c.exemple.fr/x", None),
             (202, "page", "", True, "http://a.example.com/", None), (203, "document", FR[:50], False, None, "a.example.com")]
    # A wrong declaration doesn't outweigh a clear text.
    rows += [(204, "page", page("en", FR * 3), True, "http://b.exemple.fr/", None)]
    out = found(spark, rows)
    assert len(out) == len(rows)
    assert all(out[i].lang == "en" and out[100 + i].lang == "fr" for i in range(40))
    assert [out[i].lang for i in range(200, 205)] == ["fr", "fr", "en", "fr", "fr"]
    assert out[204].declared == "en" and out[202].probability > 0.5 and all(0 < r.probability <= 1 for r in out.values())


def test_counts_against_plain_version(spark):
    labelled = spark.createDataFrame([(EN, "en"), (FR + "É", "fr"), ("", "fr"), (None, "en"), ("ab", "en")], "text string, lang string")
    got = languages.trigram_counts(labelled.repartition(3), ["en", "fr"])
    for text, row in ((EN, got[0]), (FR + "É", got[1])):
        raw = [int(languages.FOLDED[b]) for b in text.encode()]
        want = {}
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            h = ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 16
            want[h] = want.get(h, 0) + 1
        assert {int(i): int(row[i]) for i in row.nonzero()[0]} == want


def test_visible_text():
    assert languages.visible(b"a<b>c</b><!-- x <i> y --> d<style>p{}</style>e<SCRIPT>1<2</SCRIPT>f 1 < 2").split() == [
        b"a", b"c", b"d", b"e", b"f", b"1", b"2"]


def test_awkward_rows(spark, awkward, nothing):
    out = languages.identify(languages.of_documents(awkward), awkward.select("text", "lang"))
    assert out.count() == awkward.count() and out.where("lang is null").count() == 0
    none = awkward.select("text", F.lit(None).cast("string").alias("lang"))
    assert {r.lang for r in languages.identify(languages.of_documents(awkward), none).collect()} == {None}
    assert languages.identify(languages.of_documents(nothing), awkward.select("text", "lang")).collect() == []
    pages = spark.createDataFrame([(1, None, None), (None, "not an address", "<html lang=xx"), (2, "http://[::1]/", "<" * 500)],
                                  "page_id long, url string, html string")
    assert languages.identify(languages.of_pages(pages), awkward.select("text", "lang")).count() == 3

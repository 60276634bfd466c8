"""The stages of the corpus pipeline against plain versions on a small corpus."""

import zlib

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from storelens.llm import packing
from tests.llm.conftest import DOCS, plain_words, prose
from tests.llm.test_quality import corpus
from tests.llm.test_simhash import plain_components, plain_print

ITEM = prose(77_777, 40)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, marks = corpus(300)
    shared = prose(9_999, 80)
    for i in range(300, 330):
        text = prose(i, 60) + " " + shared + " " + prose(5000 + i, 20 + i % 9)
        rows.append((i, text, "en", "s", len(text)))
    for i in range(330, 350):
        text = rows[i - 329][1] if i % 2 else prose(i, 50) + " " + ITEM
        rows.append((i, text, "de", "t", len(text)))
    rows += [(None, "a text without an id " * 3, "en", "s", 0), (350, prose(350, 70), "en", "s", 0), (350, prose(350, 70), "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([m[:3] for m in marks], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    from storelens.llm.shared import workers_find_library

    workers_find_library(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for rows in stages[1:5]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_quality_drops_what_it_rejects(stages):
    before, after = stages[:2]
    dropped = ids(before) - ids(after)
    marked = {i for i, q, *_ in corpus(300)[1] if not q}
    assert len(dropped & marked) > 0.8 * len(marked) and len(dropped - marked) < 0.1 * len(before)


def test_near_dedup_leaves_one_of_each_group(stages):
    before, after = stages[1:3]
    named = {r.doc_id: r.text for r in before if r.doc_id is not None}
    roots = plain_components(sorted(named), [plain_print(named[i]) for i in sorted(named)])
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(set(roots.values()))
    assert None in ids(after) and [r.doc_id for r in after].count(350) == 1


def test_substring_dedup_cuts_repeats(stages):
    before, after = stages[2:4]
    assert sorted(map(str, ids(before))) == sorted(map(str, ids(after))) and len(before) == len(after)
    shared = prose(9_999, 80)
    holders = sorted(r.doc_id for r in before if shared in r.text)
    assert len(holders) > 20 and [r.doc_id for r in after if shared in r.text] == holders[:1]
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        if r.doc_id not in holders:
            assert r.text == texts[r.doc_id]
        elif r.doc_id != holders[0]:
            assert plain_words(r.text) == plain_words(texts[r.doc_id].replace(shared, " "))


def test_decontamination_drops_holders_of_items(stages):
    before, after = stages[3:5]
    assert ids(before) - ids(after) == {r.doc_id for r in before if ITEM in r.text} != set()


def test_packing_holds_every_id_once(stages):
    tokenizer = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    docs, pieces = stages[4:]
    for r in docs:
        own = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start):
            part = own[p.start : p.start + p.length]
            assert p.start == at and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p.length
        assert at == len(own)


def test_run_gives_the_last_stage(spark, folder, stages):
    rows = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (str(r.doc_id), r.start, r.ids_crc32)
    assert {r.doc_id for r in rows} == ids(stages[5])
    assert sum(r.length for r in rows) == sum(r.length for r in stages[5]) and sorted(map(key, rows))[0] is not None


def test_empty_tables(spark, tmp_path):
    for name, form in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"),
                       ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], form).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

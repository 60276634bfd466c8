"""The operators for training data as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.shared import workers_find_library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        workers_find_library(spark)
        return build(spark, folder)

    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from storelens.llm import simhash

    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases, labels and score of every document."""
    from storelens.llm import licenses

    return licenses.summary(licenses.scan_licenses(table(spark, folder, "documents")))


@query
def op3_quality_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from preference pairs."""
    from storelens.llm import quality

    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_bounded_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    from storelens.llm import packing

    return packing.packed(table(spark, folder, "documents"), packing.public_tokenizer("word_bpe_49k.json"))


@query
def op1_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    from storelens.llm import warc

    return warc.archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


SQL["op1_warc_segments"] = """
with p as (
    select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as bytes,
           max(page_id) over (partition by coalesce(html, '')) as keeper
    from pages
)
select page_id, cast(bytes as bigint) as payload_bytes, sha1(payload) as payload_digest,
       case when bytes >= 1000 and page_id < keeper then 'revisit' else 'response' end as record_type,
       case when bytes >= 1000 and page_id < keeper then keeper end as refers_to, 'ok' as status
from p
"""


@query
def op5_uniform_threshold_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth one."""
    from pyspark.sql import functions as F

    from storelens.llm import topk

    return topk.top_k(topk.whole_vectors(table(spark, folder, "embeddings")), F.col("vec_id") % 100 == 0)


SQL["op5_uniform_threshold_top_k"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings
), s as (
    select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1),
           lambda i: q.v[i] * c.v[i])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id
    where q.vec_id % 100 = 0
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


@query
def op9_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document under a bigram model of those that are not held out."""
    from pyspark.sql import functions as F

    from storelens.llm import kneser_ney
    from storelens.llm.quality import remainder

    out = remainder("doc_id", 7) == 2
    scored = kneser_ney.language_model(table(spark, folder, "documents"), out)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), *scored.columns[1:])


@query
def op8_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least fifty words that repeat those of a smaller document."""
    from storelens.llm import passages

    return passages.repeated_passages(table(spark, folder, "documents"))


@query
def op6_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names."""
    from storelens.llm import templates

    return templates.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page and every document."""
    from pyspark.sql import functions as F

    from storelens.llm import languages

    docs = table(spark, folder, "documents")
    rows = languages.of_pages(table(spark, folder, "pages")).unionByName(languages.of_documents(docs))
    found = languages.identify(rows, docs.select("text", "lang"))
    return found.select(
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        "lang", "probability", "text_lang", "declared")


@query
def op12_pivoted_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the first four components of the distinct ones; a deviation beyond 64 bits is null."""
    from pyspark.sql import functions as F

    from storelens.llm import whitening

    rows = whitening.whitened(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of at least three places with the spelling that it is a variant of."""
    from storelens.llm import spelling

    return spelling.variants(table(spark, folder, "documents"))


@query
def op11_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    from storelens.llm import personal

    return personal.summary(personal.personal_data(table(spark, folder, "documents")))

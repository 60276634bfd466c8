"""Language identification by Bayesian fusion of evidence.

Four sources meet in each row's posterior: the likelihood of its text (naive Bayes over hashed byte trigrams, counted
over all labelled texts), the language that its markup declares, the suffix of its address, and a prior of its host.
What a declaration or a suffix is worth, and what a host publishes, is learnt from the texts themselves: grouped sums of
the rows' text posteriors. The host prior is smoothed towards its domain's, and that towards the whole table's, and
leaves out the row's own share. Languages are those of the labels.

Trigrams overlap, so the text's log likelihood counts by a third (``TEXT_WEIGHT``). Sources that a row hasn't got say
nothing.

Defined results: no text counts as empty and leaves the decision to the other sources; without any, the most common
language has it; of equal posteriors the first language in order of the alphabet; repeated rows come out as often as they
went in, rows without an id too; without labels the language is null; an empty table gives an empty result. Other
columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import salted_join, written
from storelens.llm.words import LOWER, parts

BITS = 16
TEXT_WEIGHT = 1 / 3
SMOOTH = 0.5
# Weight of the level above, in rows.
HOST_WEIGHT = 5.0
EVIDENCE_WEIGHT = 10.0
# Languages a model may have; a model has 2**BITS numbers for each.
MOST_LANGUAGES = 256
SHARES = 64

DECLARED = re.compile(rb"""<html\b[^<>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)
META = re.compile(rb"""<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)
HIDDEN = (b"script", b"style")

# Letters and all that isn't ASCII as they are, anything else a space.
FOLDED = np.where(((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128), LOWER, 32).astype(np.uint8)


def visible(html: bytes) -> bytes:
    """Text between tags, without scripts, styles and comments, in one pass."""
    pieces = html.split(b"<")
    out = [pieces[0]]
    skip = None
    for piece in pieces[1:]:
        if skip is not None:
            if not piece[: len(skip)].lower() == skip:
                if skip == b"--" and b"-->" in piece:
                    out.append(piece.rpartition(b"-->")[2])
                    skip = None
                continue
            skip = None
        if piece.startswith(b"!--"):
            if b"-->" in piece:
                out.append(piece.partition(b"-->")[2])
            else:
                skip = b"--"
            continue
        if not (piece[:1].isalpha() or piece[:1] in (b"/", b"!", b"?")):
            out.append(piece)  # no tag
            continue
        name = piece[:6].lower()
        hidden = next((h for h in HIDDEN if name.startswith(h)), None)
        if hidden:
            skip = b"/" + hidden
            continue
        out.append(piece.partition(b">")[2])
    return b" ".join(out)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of the texts, and where each text's begin and end."""
    data = FOLDED[np.frombuffer(b" ".join(texts) + b"   ", dtype=np.uint8)].astype(np.uint32)
    hashes = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    return hashes.astype(np.int64), at[:-1], np.maximum(at[1:] - 3, at[:-1])


def trigram_counts(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """One row of 2**BITS counts for each language."""
    place = {lang: i for i, lang in enumerate(languages)}
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * size, dtype=np.int64)
        for rows, texts in parts(batches):
            hashes, first, last = trigrams(texts)
            of = np.array([place[x] for x in rows.column("lang").to_pylist()])
            lengths = last - first
            inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            total += np.bincount(np.repeat(of, lengths) * size + hashes[np.repeat(first, lengths) + inner],
                                 minlength=len(total))
        yield from packed(total, TaskContext.get().partitionId() % SHARES)

    def packed(total: np.ndarray, share: int) -> Iterator[pa.RecordBatch]:
        each = total.reshape(len(languages), size)
        at = np.flatnonzero(each.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), share, dtype=np.int32)),
                 pa.array([each[i].tobytes() for i in at])], ["place", "share", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), size), dtype=np.int64)
        for batch in batches:
            for i, counts in zip(batch.column("place").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[i] += np.frombuffer(counts, dtype=np.int64)
        yield from packed(total.ravel(), 0)

    form = "place int, share int, counts binary"
    sums = labelled.mapInArrow(count, form).repartition("place", "share").mapInArrow(add, form)
    out = np.zeros((len(languages), size), dtype=np.int64)
    for r in sums.repartition("place").mapInArrow(add, form).collect():
        out[r["place"]] += np.frombuffer(r["counts"], dtype=np.int64)
    return out


def measured(rows: DataFrame, likelihood: np.ndarray) -> DataFrame:
    """Rows (id, kind, text, is_html, url, host) with what each source says: ``fit``, the weighted log likelihood of
    each language, ``declared``, ``suffix``, ``host`` and ``domain``."""
    width = likelihood.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in parts(batches):
            declared, bodies = [], []
            for html, x in zip(part.column("is_html").to_pylist(), texts, strict=True):
                found = (DECLARED.search(x) or META.search(x)) if html else None
                declared.append(found[1].lower().decode() if found else None)
                bodies.append(visible(x) if html else x)
            hashes, first, last = trigrams(bodies)
            sums = np.zeros((len(hashes) + 1, width))
            np.cumsum(likelihood[hashes], axis=0, out=sums[1:])
            fit = (sums[last] - sums[first]) * TEXT_WEIGHT
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("kind"), part.column("host"), part.column("suffix"),
                pa.array(declared, type=pa.string()),
                pa.ListArray.from_arrays(np.arange(len(fit) + 1, dtype=np.int32) * width, pa.array(fit.ravel())),
            ], ["id", "kind", "host", "suffix", "declared", "fit"])

    host = F.coalesce("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://([^/:?#]+)", 1)))
    slim = rows.select("id", "kind", "text", "is_html", F.nullif(host, F.lit("")).alias("host")).withColumn(
        "suffix", F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -1)))
    out = slim.mapInArrow(
        measure, "id long, kind string, host string, suffix string, declared string, fit array<double>")
    # The domain is the host's last two names.
    return out.withColumn("domain", F.substring_index("host", ".", -2))


def softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def identify(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, kind, lang, probability, text_lang, declared) of rows (id, kind, text, is_html, url, host), with text
    likelihoods from ``labelled`` (text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull()).select("text", "lang")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages among the labels")
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("id", "kind", none.alias("lang"), F.lit(None).cast("double").alias("probability"),
                           none.alias("text_lang"), none.alias("declared"))
    counts = trigram_counts(labelled, languages) + SMOOTH
    likelihood = np.log(counts / counts.sum(axis=1, keepdims=True)).T.copy()
    known = written(measured(rows, likelihood).withColumn("post", softmax(F.col("fit"))), "languages")

    shares = F.array(*[F.sum(F.get("post", i)) for i in range(n)])
    whole = known.agg(shares.alias("s"), F.count(F.lit(1)).alias("rows")).first()
    overall = [((x or 0.0) + 1.0) / (whole["rows"] + n) for x in whole["s"]]
    base = F.array(*[F.lit(x) for x in overall])

    def smoothed(sums: Column, above: Column, weight: float) -> Column:
        total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(sums, above, lambda x, y: (x + weight * y) / (total + weight))

    hosts = known.where(F.col("host").isNotNull()).groupBy("host", "domain").agg(shares.alias("host_sums"))
    domains = hosts.groupBy("domain").agg(
        F.array(*[F.sum(F.get("host_sums", i)) for i in range(n)]).alias("s")
    ).select("domain", smoothed(F.col("s"), base, HOST_WEIGHT).alias("above"))
    hosts = salted_join(hosts, domains, ["domain"], "host").drop("domain")

    def evidence(column: str, name: str) -> DataFrame:
        """How likely each language is to show a value, relative to how likely the value is at all."""
        sums = known.where(F.col(column).isNotNull()).groupBy(column).agg(shares.alias("s"))
        ratio = F.zip_with(smoothed(F.col("s"), base, EVIDENCE_WEIGHT), base, lambda x, y: F.log(x / y))
        return sums.select(column, ratio.alias(name))

    joined = salted_join(known, hosts, ["host"], "id", "left")
    joined = salted_join(joined, evidence("declared", "said"), ["declared"], "id", "left")
    joined = salted_join(joined, evidence("suffix", "addressed"), ["suffix"], "id", "left")
    # The row's own share of its host's sums is left out.
    others = F.zip_with("host_sums", "post", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    prior = F.coalesce(smoothed(others, F.col("above"), HOST_WEIGHT), base)
    nothing = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    scores = add(add("fit", F.transform(prior, lambda x: F.log(x))),
                 add(F.coalesce("said", nothing), F.coalesce("addressed", nothing)))
    names = F.array(*[F.lit(x) for x in languages])
    first = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return joined.withColumn("scores", scores).withColumn("final", softmax(F.col("scores"))).select(
        "id", "kind", first(F.col("scores")).alias("lang"), F.array_max("final").alias("probability"),
        first(F.col("fit")).alias("text_lang"), "declared")


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows of ``identify``."""
    return pages.select(F.col("page_id").cast("long").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("text"),
                        F.lit(True).alias("is_html"), "url", F.lit(None).cast("string").alias("host"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows of ``identify``; their source stands for the host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.lit("document").alias("kind"), "text",
                       F.lit(False).alias("is_html"), F.lit(None).cast("string").alias("url"),
                       F.col("source").alias("host"))

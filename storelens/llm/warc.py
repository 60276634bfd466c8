"""WARC archives: written from pages with segments and chunked framing, and put together again.

Writing: each page's payload is framed in HTTP chunks; a record longer than a segment is written as a response and
continuation records that name the first one. Pages with equal payloads of at least ``SHARED`` bytes share one: the
page with the largest id keeps it, the others are revisits without a payload. Records are rows of text whose line ends
are the two line breaks after a WARC record, so Spark's own writer makes the (compressed) archives, wherever the
folder lies, and a task that is run again replaces its file.

Reading: files are streamed, split at the mark that begins a record and joined again where a payload holds that mark.
Segments are grouped by the id of the record that they continue, put in order of their numbers, checked against the
total length that the last one states, and the chunks are decoded. ``status`` tells what is wrong with a record; its
payload is then null.

Defined results: no payload counts as an empty one; pages with the same largest id and payload all keep it; pages
without an id are written, and revisit a page with an id if there is one; repeated rows are records of their own; when
read, records with the same record id count as one; an empty table gives an empty result; other columns are left out. A payload may be as long as Spark's largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.shared import salted_join, scratch_path

SHARED = 1000
CHUNK = 4096
SEGMENT = 16384
MARK = b"WARC/1."
DATE = "2020-01-01T00:00:00Z"
LINE = "\r\n"

RECORD = pa.schema([
    ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
    ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_bytes", pa.int64()),
    ("stated_digest", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("status", pa.string()), ("payload", pa.binary()),
])
READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("segments", pa.int32()), ("status", pa.string()),
    ("payload", pa.binary()),
])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with their payload, its digest, the kind of record and the page that a revisit refers to."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.translate(F.coalesce(F.col(url), F.lit("")), "\r\n", "").alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    keepers = (
        rows.where(F.col("bytes") >= SHARED).groupBy("digest", "bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and keeper.page_id is not null").drop("n")
    )
    joined = salted_join(rows, keepers, ["digest", "bytes"], "page_id", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))
    return joined.select(
        "page_id", "url", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper.page_id")).alias("refers_to"), F.when(revisit, F.col("keeper.url")).alias("refers_url"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def _chunked(payload: Column, size: int) -> Column:
    """The payload in chunked framing, as text of the same bytes."""
    count = F.ceil(F.length(payload) / size).cast("int")
    one = lambda i: F.concat(
        F.lower(F.hex(F.least(F.lit(size), F.length(payload) - i * size))), F.lit(LINE),
        F.substring(payload, i * size + 1, F.lit(size)).cast("string"), F.lit(LINE))
    chunks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array())
    return F.concat(F.array_join(chunks, ""), F.lit("0" + LINE + LINE))


def write_archive(rows: DataFrame, path: str, chunk: int = CHUNK, segment: int = SEGMENT) -> None:
    """Write captures as compressed WARC files into a folder."""
    revisit = F.col("record_type") == "revisit"
    # A revisit keeps the head of the response, with the payload's length.
    block = F.when(revisit, F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html{LINE}Content-Length: "), "bytes", F.lit(LINE + LINE))
    ).otherwise(F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html{LINE}Transfer-Encoding: chunked{LINE}{LINE}"),
        _chunked(F.col("payload"), chunk))).cast("binary")
    rows = rows.withColumn("id", F.monotonically_increasing_id()).withColumn("block", block).drop("payload")
    rows = rows.withColumn("total", F.length("block")).withColumn("segments", F.ceil(F.col("total") / segment).cast("int"))
    rows = rows.withColumn("part", F.explode(F.transform(
        F.sequence(F.lit(1), "segments"),
        lambda k: F.struct(k.alias("k"), F.substring("block", (k - 1) * segment + 1, F.lit(segment)).alias("bytes")))))
    own = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), "id")
    first, segmented = F.col("part.k") == 1, F.col("segments") > 1

    def line(name: str, value: Column | str, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
        return text if when is None else F.when(F.coalesce(when, F.lit(False)), text).otherwise("")

    record = F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", F.concat(own, F.when(first, "").otherwise(F.concat(F.lit(":"), "part.k")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", "url"),
        line("X-Page-Id", F.col("page_id").cast("string"), F.col("page_id").isNotNull() & first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Refers-To-Target-URI", "refers_url", revisit),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string"), revisit),
        line("WARC-Segment-Number", F.col("part.k").cast("string"), segmented),
        line("WARC-Segment-Origin-ID", F.concat(own, F.lit(">")), ~first),
        line("WARC-Segment-Total-Length", F.col("total").cast("string"),
             segmented & (F.col("part.k") == F.col("segments"))),
        F.lit(f"Content-Type: application/http;msgtype=response{LINE}"),
        line("Content-Length", F.length("part.bytes").cast("string")), F.lit(LINE), F.col("part.bytes").cast("string"),
    )
    rows.select(record.alias("value")).write.option("lineSep", LINE * 2).option("compression", "gzip").text(path)


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(batches: Iterator[pa.RecordBatch], payloads: bool = True) -> Iterator[pa.RecordBatch]:
    """Records of archive files, given as (file, value): what stands between two marks, in order. A record that is no
    segment of a longer one is decoded at once."""
    whole = lambda v: int(v) if v and v.isdigit() else None
    out: list[tuple] = []
    size = 0
    held: list[bytes] = []
    length, need, of = 0, None, None
    for batch in batches:
        for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if file != of or not held:
                # What a file ends with incompletely doesn't run into the next one.
                held, length, need, of = [value], len(value), None, file
            else:
                held += [MARK, value]
                length += len(MARK) + len(value)
            if need is None:
                raw = b"".join(held)
                held = [raw]
                end = raw.find(b"\r\n\r\n")
                if end < 0:
                    held = held if raw else []
                    continue
                fields = _fields(raw[:end])
                need = end + 4 + int(fields.get("content-length", 0))
            if length < need:
                continue
            block = b"".join(held)[end + 4 : need]
            held = []
            kind = fields.get("warc-type", "")
            if kind not in ("response", "revisit", "continuation"):
                continue
            stated = _fields(block[: block.find(b"\r\n\r\n")]) if kind == "revisit" else {}
            continued = kind == "continuation"
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            number, total = whole(fields.get("warc-segment-number")), whole(fields.get("warc-segment-total-length"))
            length_of = whole(stated.get("content-length"))
            done = (None,) * 4
            if number is None and not continued:
                done = assembled(kind, [{"number": 1, "total": total, "block": block}], length_of, digest)
                done, block = (*done[:3], done[3] if payloads else None), None
            out.append((
                fields.get("warc-segment-origin-id") if continued else fields.get("warc-record-id"),
                number or 1, total, whole(fields.get("x-page-id")), None if continued else fields.get("warc-target-uri"),
                None if continued else kind, whole(fields.get("x-refers-to-page-id")), length_of, digest, block, *done,
            ))
            size += len(block or done[3] or b"")
            if size > 1 << 22 or len(out) > 2000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), RECORD, strict=True)], schema=RECORD)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), RECORD, strict=True)], schema=RECORD)


def assembled(kind: str | None, segments: list[dict], stated_bytes: int | None, digest: str | None):
    """(payload_bytes, digest, status, payload) of a record from its segments in order."""
    if kind is None or [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        return None, digest, "segments missing", None
    block = b"".join(s["block"] for s in segments)
    total = segments[-1]["total"]
    if total != len(block) if len(segments) > 1 else total not in (None, len(block)):
        return None, digest, "length differs", None
    if kind == "revisit":
        return stated_bytes, digest, "ok", None
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if _fields(head).get("transfer-encoding", "").lower() == "chunked" else body
    if payload is None:
        return None, digest, "chunks broken", None
    found = hashlib.sha1(payload).hexdigest()
    return len(payload), found, "ok" if digest in (None, found) else "digest differs", payload


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each response and revisit of the archives in a folder, with the decoded payload if asked for."""
    lines = spark.read.option("lineSep", MARK.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    parts = lines.mapInArrow(lambda batches: records(batches, payloads), _ddl(RECORD))
    first = lambda name: F.max(name).alias(name)
    whole = parts.groupBy("origin").agg(
        *[first(c) for c in ("page_id", "url", "record_type", "refers_to", "stated_bytes", "stated_digest",
                             "payload_bytes", "payload_digest", "status", "payload")],
        F.array_sort(F.collect_list(F.struct("number", "total", "block"))).alias("segments"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time, as each may hold a large payload.
            for low in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(low, 256).to_pylist():
                    size, digest, status, payload = assembled(
                        r["record_type"], r["segments"], r["stated_bytes"], r["stated_digest"]
                    ) if r["status"] is None else (r["payload_bytes"], r["payload_digest"], r["status"], r["payload"])
                    out.append((r["page_id"], r["url"], r["record_type"], r["refers_to"], size, digest,
                                len(r["segments"]), status, payload if payloads else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), READ, strict=True)], schema=READ)

    return whole.mapInArrow(decode, _ddl(READ))


def archived(pages: DataFrame) -> DataFrame:
    """The pages written as archives to the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(captures(pages), path)
    return read_archive(pages.sparkSession, path, payloads=False)

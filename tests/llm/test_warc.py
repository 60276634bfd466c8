import glob
import gzip
import hashlib
import random

from storelens.llm import warc
from storelens.llm.shared import scratch_path

PAGES = "page_id long, url string, html string"


def round_trip(spark, rows, **sizes):
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as bytes", "'x' as digest", "'y' as record_type")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(warc.captures(pages), path, **sizes)
    return path, warc.read_archive(spark, path).collect()


ROWS = [
    (1, "http://a/1", "<p>" + "x" * 5000), (2, "http://a/2", "<p>" + "x" * 5000), (3, None, "short"), (4, "http://a/4", "short"),
    (5, "u", ""), (6, "u", None), (7, "u\r\nX: 1", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 again" * 40),
    (8, "u", "é中\U0001f600" * 900), (None, "u", "n" * 1200), (9, "u", "n" * 1200), (10, "u", "\r\n\r\n" * 700),
    (11, "u", "t" * 1000), (11, "u", "t" * 1000), (12, "u", "a" * 999), (13, "u", "a" * 999), (14, "u", "0\r\n\r\n" * 300),
]


def test_round_trip(spark):
    for sizes in ({"chunk": 100, "segment": 333}, {}):
        _, rows = round_trip(spark, ROWS, **sizes)
        assert len(rows) == len(ROWS) and {r.status for r in rows} == {"ok"}
        payloads = {p: (h or "").encode() for p, _, h in ROWS}
        for r in rows:
            assert r.payload_bytes == len(payloads[r.page_id])
            assert r.payload_digest == hashlib.sha1(payloads[r.page_id]).hexdigest()
            assert r.payload == (None if r.record_type == "revisit" else payloads[r.page_id])
        revisits = {(r.page_id, r.refers_to) for r in rows if r.record_type == "revisit"}
        assert revisits == {(1, 2), (None, 9)}
        if sizes:
            assert max(r.segments for r in rows) > 10


def test_segments_in_any_order_and_files(spark, tmp_path):
    path, rows = round_trip(spark, ROWS, chunk=64, segment=200)
    mark = b"WARC/1.1\r\nWARC-Type"
    records = []
    for file in sorted(glob.glob(f"{path}/*.gz")):
        with gzip.open(file) as f:
            records += f.read().split(mark)[1:]
    random.Random(4).shuffle(records)
    assert len(records) > 100
    for k in range(7):
        with gzip.open(tmp_path / f"{k}.warc.gz", "wb") as f:
            # A file that ends within a record first loses that record alone.
            f.writelines(mark + r for r in records[k::7])
            f.write(mark + b": response\r\nContent-Length: 99\r\n\r\ncut")
    again = warc.read_archive(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_broken_records_are_told_apart():
    seg = lambda n, block, total=None: {"number": n, "total": total, "block": block}
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    good = head + b"3\r\nabc\r\n0\r\n\r\n"
    assert warc.assembled("response", [seg(1, good)], None, None)[2:] == ("ok", b"abc")
    assert warc.assembled("response", [seg(1, good[:10]), seg(2, good[10:], len(good))], None, None)[2:] == ("ok", b"abc")
    assert warc.assembled("response", [seg(1, good[:10]), seg(3, good[10:], len(good))], None, None)[2] == "segments missing"
    assert warc.assembled(None, [seg(2, good, len(good))], None, None)[2] == "segments missing"
    assert warc.assembled("response", [seg(1, good[:10]), seg(2, good[10:], 999)], None, None)[2] == "length differs"
    assert warc.assembled("response", [seg(1, good[:10]), seg(2, good[10:])], None, None)[2] == "length differs"
    assert warc.assembled("response", [seg(1, head + b"zz\r\nabc")], None, None)[2] == "chunks broken"
    assert warc.assembled("response", [seg(1, good)], None, "0" * 40)[2] == "digest differs"


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.archived(pages).collect() == []

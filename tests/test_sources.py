"""Readers, sinks and streams over files."""

import datetime as dt
import json
from types import SimpleNamespace

import pytest
from tests.conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storelens.operators.ingest import flash_sale_post, purchase_post
from storelens.plans import session
from storelens.sources.readers import bulk_item_scan, nested_order_scan, table_source
from storelens.sources import sinks
from storelens.streaming import carts, feeds

from test_answers import compare

ORDER = {
    "order_id": 1, "user_id": 5, "address_delivery": "Lane 1", "total_amount": 30.5, "order_status": "Pending",
    "payment_status": "pending", "payment_method": "COD", "delivery_id": 1, "delivery_start": "2024-01-01 10:00:00",
    "coupon_code": "TEN", "transaction_id": "", "items_details": [
        {"product_id": 7, "product_name": "Tea", "product_unit": 1, "product_qty": 2, "product_rate": 5, "product_amount": 10},
        {"product_id": 8, "product_name": "Rice", "product_unit": 1, "product_qty": 1, "product_rate": 20.5,
         "product_amount": 20.5, "discount_amt": 1, "discount_per": 2}]}


@pytest.fixture
def documents(spark):
    card = {**ORDER, "order_id": 2, "payment_method": "UPI", "transaction_id": "t9", "coupon_code": "", "items_details": []}
    return spark.createDataFrame([(json.dumps(ORDER),), (json.dumps(card),)], "document string")


def test_item_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("title,categoriesname,description,price,mrp,quantity,unit\n"
                    "Owner's tea,Food,,12.50,,3,KG\n,,,,,,\n", encoding="utf-8")
    got = bulk_item_scan(spark, str(path))
    assert [f.dataType.simpleString() for f in got.schema.fields][3] == "decimal(10,2)"
    assert [tuple(map(str, r)) for r in got.collect()][0] == ("Owner's tea", "Food", "", "12.50", "0.00", "3", "KG")
    path.write_text("title,categoriesname,description,price,mrp,quantity,unit\n", encoding="utf-8")
    with pytest.raises(ValueError):
        bulk_item_scan(spark, str(path))


def test_table_source_kinds(spark, tmp_path):
    df = spark.range(5)
    for kind in ("parquet", "orc", "json"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert table_source(spark, str(tmp_path / kind), kind).count() == 5


def test_nested_order(documents):
    headers, lines = nested_order_scan(documents)
    assert rows(headers, "order_id", "payment_method") == [(1, "COD"), (2, "UPI")]
    # An order without lines keeps one empty row.
    assert rows(lines, "order_id", "item_no", "product_id") == [(1, 0, 7), (1, 1, 8), (2, None, None)]


COUPONS = "coupon_id long, coupon_code string"


def fanout(spark, documents, coupons=((3, "TEN"),)):
    return sinks.tagged_fanout(documents, spark.createDataFrame(list(coupons), COUPONS), dt.date(2024, 1, 1))


def test_fanout_is_written_once_per_batch(spark, documents, tmp_path):
    tagged = fanout(spark, documents)
    for _ in range(2):
        sinks.write_fanout(tagged, str(tmp_path), 0)
    back = sinks.read_fanout(spark, str(tmp_path), tagged.schema)
    back = {name: back.where(F.col("output") == name).select(f"{name}.*") for name in sinks.OUTPUTS}
    assert {n: df.count() for n, df in back.items()} == {
        "orders": 2, "order_items": 2, "ledger": 2, "payments": 2, "tracking": 2, "coupon_usage": 1}
    assert rows(back["payments"], "order_id", "status", "transaction_id") == [(1, "PENDING", None), (2, "complete", "t9")]
    assert rows(back["ledger"], "itmid", "instoreid", "outstoreid", "stockqty") == [(7, 0, 2, 2), (8, 0, 2, 1)]
    assert rows(back["order_items"].select(F.col("discount_amt").cast("int"))) == [(0,), (1,)]
    apart = sinks.order_fanout(documents, spark.createDataFrame([(3, "TEN")], COUPONS), dt.date(2024, 1, 1))
    assert all(rows(apart[n]) == rows(back[n]) and apart[n].columns == back[n].columns for n in sinks.OUTPUTS)


def test_fanout_reads_its_documents_once(spark, documents, tmp_path):
    seen = Observation("documents")
    once = documents.observe(seen, F.count(F.lit(1)).alias("n"))
    tagged = fanout(spark, once)
    assert tagged._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") == 1
    sinks.write_fanout(tagged, str(tmp_path), 4)
    assert seen.get["n"] == 2


def test_a_batch_of_the_fanout_is_replaced_whole_or_not_at_all(spark, documents, tmp_path):
    folder = str(tmp_path)
    tagged = fanout(spark, documents)
    sinks.write_fanout(tagged, folder, 0)
    sinks.write_fanout(fanout(spark, documents.limit(1)), folder, 1)
    counts = lambda: rows(sinks.read_fanout(spark, folder, tagged.schema).groupBy("output").count())
    whole = counts()
    # A write of batch 0 that fails on its way, and one that is not yet said to be done.
    broken = tagged.withColumn("output", F.when(F.col("output") == "tracking", F.raise_error(F.lit("lost"))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_fanout(broken, folder, 0)
    tagged.write.partitionBy("output").parquet(f"{folder}/rows/part=unfinished")
    assert counts() == whole
    sinks.write_fanout(fanout(spark, documents.limit(0)), folder, 0)
    assert counts() == rows(fanout(spark, documents.limit(1)).groupBy("output").count())
    assert sinks.read_fanout(spark, str(tmp_path / "none"), tagged.schema).count() == 0


def test_fanout_of_odd_documents(spark):
    two = {**ORDER, "order_id": 3, "part_no": 1}
    odd = [None, "", "no json", json.dumps({**ORDER, "items_details": None, "coupon_code": "NONE"}), json.dumps(two)]
    tagged = fanout(spark, spark.createDataFrame([(d,) for d in odd], "document string"), [(3, "TEN"), (4, "TEN"), (5, None)])
    made = lambda name: rows(tagged.where(F.col("output") == name).select(f"{name}.*"), "order_id")
    # The second part of an order has lines and no header; what is no document makes no rows.
    assert made("order_items") == [(3,), (3,)] and made("orders") == made("tracking") == [(1,)]
    assert made("coupon_usage") == []
    first = spark.createDataFrame([(json.dumps(ORDER),)], "document string")
    twice = fanout(spark, first, [(3, "TEN"), (4, "TEN")]).where("output = 'coupon_usage'").select("coupon_usage.*")
    assert rows(twice, "coupon_id") == [(3,), (4,)]


def test_purchase_and_flash_documents(spark):
    purchase = {"purchase_header": {"purchase_date": "2024-01-05"}, "purchase_items": [
        {"item_id": 1, "item_name": "a", "unit_id": 2, "quantity": 3, "rate": 4, "value": 12, "instore_id": 1, "outstore_id": 0}]}
    df = spark.createDataFrame([(1, 9, json.dumps(purchase)), (2, 9, json.dumps(purchase))], "seq long, register_id long, document string")
    headers, lines = purchase_post(df, last=41)
    assert rows(headers, "purchase_no") == [("PUR0041",), ("PUR0042",)]
    assert rows(lines, "seq", "purchase_date", "stockqty", "currentstock") == [
        (1, dt.date(2024, 1, 5), 3, 3), (2, dt.date(2024, 1, 5), 3, 3)]
    sale = {"from_datetime": "2025-12-01T22:10:00", "to_datetime": "2025-12-11T23:45:00",
            "items_details": [{"product_id": 2, "product_rate": 46}, {"product_id": 4, "product_qty": 10}]}
    headers, lines = flash_sale_post(spark.createDataFrame([(1, 9, json.dumps(sale))], "seq long, register_id long, document string"))
    assert headers.first()["flash_no"] == "FLS0001" and headers.first()["from_datetime"] == dt.datetime(2025, 12, 1, 22, 10)
    assert [r[0] for r in lines.orderBy("item_no").select("product_rate").collect()][1] is None


STREAMS = ["new_order_feed", "stream_daily_revenue", "stream_stock_level", "stream_order_status", "stream_cart_state"]


@pytest.fixture(scope="module")
def scattered(spark, data, tmp_path_factory):
    """The tables as folders of six files of rows in no order."""
    folder = tmp_path_factory.mktemp("scattered")
    for name in ("customer", "orders", "lineitem", "events", "part"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        df.repartition(6, F.xxhash64(*df.columns)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("whole_every", [2, 32])
@pytest.mark.parametrize("name", STREAMS)
def test_streams_over_six_batches_give_the_batch_answer(spark, duck, data, scattered, monkeypatch, name, whole_every):
    monkeypatch.setattr(feeds, "WHOLE_EVERY", whole_every)
    monkeypatch.setattr(carts, "STRETCH_BITS", whole_every)
    plain_stream = feeds.file_stream
    monkeypatch.setattr(feeds, "file_stream", lambda *a: plain_stream(*a, files_per_batch=1))
    compare(spark, duck, scattered, name)


@pytest.mark.parametrize("name", STREAMS)
def test_streams_over_nothing_give_nothing(spark, data, tmp_path, name):
    for table in ("customer", "orders", "lineitem", "events", "part"):
        df = spark.read.parquet(f"{data}/{table}.parquet")
        (df if table == "part" else df.limit(0)).write.parquet(f"{tmp_path}/{table}.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    if name == "stream_stock_level":
        assert got.count() == spark.read.parquet(f"{data}/part.parquet").count()
    else:
        assert got.collect() == []


def test_old_batches_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "WHOLE_EVERY", 3)
    schema = "id long, order_id long, status string, created_at timestamp_ntz"
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(11):
        # Later batches bring earlier rows.
        rows_in = [(20 - n, 1, f"S{20 - n}", dt.datetime(2024, 1, 20 - n)), (100 + n, 2, f"T{n}", dt.datetime(2024, 2, 1 + n))]
        spark.createDataFrame(rows_in, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = feeds.order_status_rows(spark.readStream.schema(schema).parquet(folder))
        feeds.fold_stream(stream, target, feeds.order_statuses).awaitTermination()
    got = feeds.read_folded(spark, target, feeds.order_statuses, stream.schema)
    assert rows(got.select("order_id", "last.status")) == [(1, "s20"), (2, "t10")]
    assert feeds.batch_numbers(spark, target) == [6, 7, 8, 9, 10]


def test_shared_folder_comes_from_the_cluster():
    def cluster(**settings):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)),
            sparkContext=SimpleNamespace(master="yarn"))

    assert session.shared_folder(cluster(**{"spark.checkpoint.dir": "hdfs://shared/x/"})) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        session.shared_folder(cluster())

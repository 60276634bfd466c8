"""Tables laid out by store against the tables cut for a store, and what a read opens."""

import glob

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from storelens.operators import orders, people, stock
from storelens.sources.binding import bind
from storelens.sources.layout import read_store, stored_tables, write_by_store
from storelens.sources.tables import TABLE_NAMES
from storelens.sources.tenancy import rows_of, store_tables

NAMES = ("tenants", "users", "orders", "order_items", "addresses", "purchases", "ledger", "products", "images", "delivery_modes")


@pytest.fixture(scope="module")
def laid_out(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stores"))
    write_by_store(bind(spark, data), folder, NAMES)
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_a_store_sees_its_rows(spark, data, laid_out, name):
    t = bind(spark, data)
    assert set(NAMES) <= set(TABLE_NAMES)
    for store in (7, 3):
        assert rows(read_store(spark, laid_out, name, store)) == rows(rows_of(t, name, store).select(*getattr(t, name).columns))


def test_operators_on_stored_tables(spark, data, laid_out):
    t, stored = store_tables(bind(spark, data), 7), stored_tables(spark, laid_out, 7, NAMES)
    for run in (lambda t: stock.stock_ledger(t), lambda t: orders.admin_order_list(t), lambda t: people.customer_list(t)):
        assert rows(run(stored)) == rows(run(t))
    with pytest.raises(LookupError):
        stored_tables(spark, laid_out, 12345, NAMES)


def test_other_stores_are_not_opened(spark, laid_out):
    ledger = read_store(spark, laid_out, "ledger", 7)
    plan = ledger._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(of_store" in plan.toString()
    assert all("/of_store=7/" in r[0] for r in ledger.select(F.input_file_name()).distinct().collect())
    ledger.collect()
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    own, every = (len(glob.glob(f"{laid_out}/ledger/{part}/*.parquet")) for part in ("of_store=7", "*"))
    plan.execute().count()
    assert scan.metrics().apply("numFiles").value() == own < every / 2


def test_rows_without_a_store_are_kept_apart(spark, data, tmp_path):
    t = bind(spark, data)
    lost = t.replace(orders=t.orders.withColumn("user_id", F.when(F.col("order_id") % 2 == 0, F.col("user_id"))))
    write_by_store(lost, str(tmp_path), ["orders"])
    back = spark.read.parquet(f"{tmp_path}/orders")
    assert back.count() == t.orders.count() and back.where("of_store is null").count() >= lost.orders.where("user_id is null").count()

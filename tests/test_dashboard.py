"""The dashboard from one scan of the orders against its parts."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelens.operators.sales import chart_and_summary, sales_chart, today_vs_yesterday
from storelens.operators.stock import dashboard_low_stock
from storelens.plans.dashboard import dashboard_rows
from storelens.plans.read_queries import AS_OF, OPEN_DATE
from storelens.sources.binding import bind
from storelens.sources.tables import Tables
from tests.conftest import rows

FORM = "order_id long, created_at timestamp_ntz, payment_status string, order_status string, total_amount decimal(10,2)"


def store_of(spark, orders):
    return Tables(orders=spark.createDataFrame(orders, FORM))


def parts(t, mode, day):
    chart, summary = sales_chart(t, mode, day), today_vs_yesterday(t, day).first()
    want = [("summary", c, None if v is None else round(float(v), 2)) for c, v in summary.asDict().items()]
    if chart is not None:
        want += [("chart", r["name"], None if r.sales is None else float(r.sales)) for r in chart.collect()]
    return sorted(want, key=repr)


def found(df):
    return rows(df.withColumn("value", F.col("value").cast("double")), "part", "name", "value")


@pytest.mark.parametrize("mode", ["Week", "Month", "Year", "year"])
@pytest.mark.parametrize("day", [dt.date(2024, 3, 1), dt.date(2024, 1, 1), dt.date(2024, 12, 31), dt.date(2024, 2, 29)])
def test_as_its_parts(spark, mode, day):
    draw = random.Random(6)
    begin = dt.datetime(2023, 12, 20)
    orders = [(i, None if i % 40 == 0 else begin + dt.timedelta(hours=6 * i),
               draw.choice(["complete", "complete", "open", None]), draw.choice(["Pending", "done", "cancelled", None]),
               draw.choice([None, Decimal("1"), Decimal("2.5"), Decimal("10")])) for i in range(1600)]
    t = store_of(spark, orders)
    assert found(chart_and_summary(t, mode, day)) == parts(t, mode, day)


def test_no_orders(spark):
    t = store_of(spark, [])
    day = dt.date(2024, 3, 1)
    assert found(chart_and_summary(t, "Week", day)) == parts(t, "Week", day)
    assert len(found(chart_and_summary(t, "Week", day))) == 6


def test_orders_are_scanned_once(spark, data):
    """As many order scans as the low-stock tile has alone, and one."""
    t = bind(spark, data)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    whole, low_stock = dashboard_rows(t, "Month", AS_OF, OPEN_DATE), dashboard_low_stock(t, default_open_date=OPEN_DATE)
    low_stock = low_stock.select("id", "stock")
    assert scans(whole) - scans(low_stock) == scans(today_vs_yesterday(t, AS_OF)) == 1

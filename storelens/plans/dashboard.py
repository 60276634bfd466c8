"""The owner's dashboard, put together from its parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.sales import chart_and_summary, sales_chart, today_vs_yesterday
from storelens.operators.stock import DEFAULT_OPEN_DATE, dashboard_low_stock
from storelens.sources.tables import Tables


def dashboard_bundle(t: Tables, mode: str, as_of: dt.date,
                     default_open_date: dt.date = DEFAULT_OPEN_DATE) -> dict[str, DataFrame | None]:
    """Chart, day figures and low-stock tile; the chart is None for an unknown mode."""
    return {
        "chart": sales_chart(t, mode, as_of),
        "summary": today_vs_yesterday(t, as_of),
        "low_stock": dashboard_low_stock(t, default_open_date=default_open_date),
    }


def dashboard_rows(t: Tables, mode: str, as_of: dt.date,
                   default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """The bundle as one relation of (part, name, value); the orders are read once."""
    low_stock = dashboard_low_stock(t, default_open_date=default_open_date)
    return chart_and_summary(t, mode, as_of).unionByName(low_stock.select(
        F.lit("low_stock").alias("part"), F.col("id").cast("string").alias("name"),
        F.col("stock").cast("decimal(18,2)").alias("value"),
    ))

"""Sales charts and dashboard figures over orders.

Each takes ``by``, the columns that tell stores apart, to answer for all
stores in one pass. Figures and gap-filled charts have every store of
``tenants``, with zeros for one that sold nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.sources.tables import Tables

# The labels of the three charts, in their order.
CHART_LABELS = {
    "Week": ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"),
    "Month": ("Week 1", "Week 2", "Week 3", "Week 4", "Week 5"),
    "Year": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
}


def _moment(day: dt.date) -> Column:
    """Start of a day, as a bound on the stored column so that files can be skipped."""
    return F.lit(dt.datetime(day.year, day.month, day.day).isoformat(sep=" ")).cast("timestamp_ntz")


def _between(start: dt.date, end: dt.date) -> Column:
    """Created on or after ``start`` and before ``end``."""
    return (F.col("created_at") >= _moment(start)) & (F.col("created_at") < _moment(end))


def _paid(paid_status: str) -> Column:
    return (F.col("payment_status") == paid_status) & (F.col("order_status") != "cancelled")


def _sales() -> Column:
    return F.sum("total_amount").cast("decimal(18,2)").alias("sales")


def chart_window(mode: str, as_of: dt.date) -> tuple[dt.date, dt.date, Column] | None:
    """First day, day after the last and label of a mode's chart; None for an unknown mode."""
    if mode == "Week":
        return as_of - dt.timedelta(days=6), as_of + dt.timedelta(days=1), F.date_format("created_at", "E")
    if mode == "Month":
        first = as_of.replace(day=1)
        week = F.floor((F.dayofmonth("created_at") - 1) / 7).cast("int") + 1
        return first, (first + dt.timedelta(days=31)).replace(day=1), F.concat(F.lit("Week "), week.cast("string"))
    if mode == "Year":
        return dt.date(as_of.year, 1, 1), dt.date(as_of.year + 1, 1, 1), F.date_format("created_at", "MMM")
    return None


def sales_week(t: Tables, as_of: dt.date, paid_status: str = "complete", by: Sequence[str] = ()) -> DataFrame:
    """Sales of the seven days up to ``as_of``, by weekday."""
    start, end, _ = chart_window("Week", as_of)
    return (
        t.orders.where(_between(start, end) & _paid(paid_status))
        .groupBy(*by, F.to_date("created_at").alias("day"))
        .agg(_sales())
        .select(*by, F.date_format("day", "E").alias("name"), "sales", "day")
    )


def sales_month(t: Tables, as_of: dt.date, paid_status: str = "complete", by: Sequence[str] = ()) -> DataFrame:
    """Sales of the month of ``as_of``, by week of the month."""
    start, end, label = chart_window("Month", as_of)
    return t.orders.where(_between(start, end) & _paid(paid_status)).groupBy(*by, label.alias("name")).agg(_sales())


def sales_year(t: Tables, as_of: dt.date, paid_status: str = "complete", by: Sequence[str] = ()) -> DataFrame:
    """Sales of the year of ``as_of``, by month."""
    start, end, _ = chart_window("Year", as_of)
    return (
        t.orders.where(_between(start, end) & _paid(paid_status))
        .groupBy(*by, F.trunc(F.to_date("created_at"), "month").alias("month"))
        .agg(_sales())
        .select(*by, F.date_format("month", "MMM").alias("name"), "sales", "month")
    )


def sales_chart(t: Tables, mode: str, as_of: dt.date, paid_status: str = "complete",
                by: Sequence[str] = ()) -> DataFrame | None:
    """Chart of a mode (``Week``, ``Month`` or ``Year``, case matters); None for any other."""
    chart = {"Week": sales_week, "Month": sales_month, "Year": sales_year}.get(mode)
    return chart(t, as_of, paid_status, by) if chart else None


def chart_gap_fill(t: Tables, mode: str, as_of: dt.date, paid_status: str = "complete",
                   by: Sequence[str] = ()) -> DataFrame | None:
    """Chart with a row for every label of the mode, zero where nothing was sold."""
    chart = sales_chart(t, mode, as_of, paid_status, by)
    if chart is None:
        return None
    labels = F.array(*[F.lit(label) for label in CHART_LABELS[mode]])
    owners = t.tenants.select(*by) if by else t.orders.sparkSession.range(1)
    spine = owners.select(*by, F.posexplode(labels).alias("position", "name"))
    return spine.join(chart.select(*by, "name", "sales"), [*by, "name"], "left").select(
        *by, "position", "name", F.coalesce("sales", F.lit(0).cast("decimal(18,2)")).alias("sales")
    )


def revenue_graph(t: Tables, now: dt.datetime, by: Sequence[str] = ()) -> DataFrame:
    """Order value per day of the last seven days, whatever the state of the order."""
    start = F.lit((now - dt.timedelta(days=7)).isoformat(sep=" ")).cast("timestamp_ntz")
    return (
        t.orders.where(F.col("created_at") >= start)
        .groupBy(*by, F.date_format("created_at", "dd MMM").alias("label"))
        .agg(F.sum("total_amount").alias("value"), F.min("created_at").alias("first_at"))
    )


def _every_store(t: Tables, figures: DataFrame, by: Sequence[str]) -> DataFrame:
    """Figures of every store, zeros for those without orders."""
    if not by:
        return figures
    return t.tenants.select(*by).join(figures, list(by), "left").select(
        *by, *[F.coalesce(c, F.lit(0).cast(figures.schema[c].dataType)).alias(c) for c in figures.columns if c not in by])


def dashboard_totals(t: Tables, paid_status: str = "SUCCESS", pending: Sequence[str] = ("Pending", "Process"),
                     by: Sequence[str] = ()) -> DataFrame:
    """Order count, paid value and open orders, in one pass."""
    paid = F.when(F.col("payment_status") == paid_status, F.col("total_amount"))
    return _every_store(t, t.orders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(F.sum(paid), F.lit(0)).alias("total_revenue"),
        F.count_if(F.col("order_status").isin(*pending)).alias("pending_orders"),
    ), by)


def today_vs_yesterday(t: Tables, day: dt.date, paid_status: str = "complete", pending: str = "Pending",
                       by: Sequence[str] = ()) -> DataFrame:
    """Orders, revenue and pending orders of a day and of the day before it."""
    start, end = day - dt.timedelta(days=1), day + dt.timedelta(days=1)
    return _every_store(
        t, t.orders.where(_between(start, end)).groupBy(*by).agg(*_day_figures(day, paid_status, pending)), by)


def _day_figures(day: dt.date, paid_status: str, pending: str) -> list[Column]:
    """The aggregates of a day and of the day before it."""
    tomorrow, yesterday = day + dt.timedelta(days=1), day - dt.timedelta(days=1)
    kept = F.col("order_status") != "cancelled"

    def figures(name: str, start: dt.date, end: dt.date) -> list[Column]:
        within = _between(start, end)
        return [
            F.count_if(within & kept).alias(f"{name}_orders"),
            F.sum(F.when(within & _paid(paid_status), F.col("total_amount"))).alias(f"{name}_revenue"),
            F.count_if(within & (F.col("order_status") == pending)).alias(f"{name}_pending"),
        ]

    return [*figures("today", day, tomorrow), *figures("yesterday", yesterday, day)]


def chart_and_summary(t: Tables, mode: str, as_of: dt.date, paid_status: str = "complete",
                      pending: str = "Pending") -> DataFrame:
    """``sales_chart`` and ``today_vs_yesterday`` as (part, name, value), from one scan of the orders of their days.

    Tasks sum by label of the chart; the few rows that this leaves (one for each label, and one for orders
    outside of the chart) give both the chart's rows and, added up, the figures of the two days.
    """
    value = "decimal(18,2)"
    days = [(as_of - dt.timedelta(days=1), as_of + dt.timedelta(days=1))]
    window = chart_window(mode, as_of)
    charted, label = F.lit(False), F.lit(None).cast("string")
    if window:
        start, end, name = window
        days.append((start, end))
        charted = _between(start, end) & _paid(paid_status)
        label = F.when(charted, name)
    # One range where the two meet, so that the condition on the stored column stays simple.
    first, last = min(a for a, _ in days), max(b for _, b in days)
    wanted = _between(first, last)
    if len(days) == 2 and max(a for a, _ in days) > min(b for _, b in days):
        wanted = wanted & (_between(*days[0]) | _between(*days[1]))
    figures = _day_figures(as_of, paid_status, pending)
    sums = t.orders.where(wanted).groupBy(label.alias("name")).agg(
        F.sum(F.when(charted, F.col("total_amount"))).alias("sales"), *figures)
    names = [c for c in sums.columns if c not in ("name", "sales")]
    row = lambda part, name, amount: F.struct(
        F.lit(part).alias("part"), name.alias("name"), amount.cast(value).alias("value"))
    totals = [F.coalesce(F.sum(c), F.lit(0)) if not c.endswith("revenue") else F.sum(c) for c in names]
    # A row for each label: at most twelve.
    bars = F.collect_list(F.when(F.col("name").isNotNull(), row("chart", F.col("name"), F.col("sales"))))
    summary = F.array(*[row("summary", F.lit(c), total) for c, total in zip(names, totals, strict=True)])
    return sums.agg(F.concat(summary, bars).alias("rows")).select(F.inline("rows"))

"""Listings page by page: by number and by cursor, with missing and equal values in the order."""

import datetime as dt

import pytest
from tests.conftest import rows

from storelens.functions.keyed import By, beyond, cursor, page
from storelens.operators import catalogue, orders, people, purchases, stock
from storelens.sources.binding import bind

NUMBERS = "k long, at timestamp_ntz, amount decimal(12,2), day date, name string"


def some_rows(spark):
    at = lambda n: None if n % 5 == 0 else dt.datetime(2024, 1, 1 + n % 3, n % 2)
    data = [(n, at(n), n % 4 if n % 7 else None, dt.date(2024, 1, 1 + n % 2), None if n % 6 == 0 else f"n{n % 4}'") for n in range(60)]
    return spark.createDataFrame([(k, a, None if m is None else __import__("decimal").Decimal(m), d, s) for k, a, m, d, s in data], NUMBERS)


@pytest.mark.parametrize("order", [
    [By("at", falling=True), By("k", falling=True)], [By("at"), By("k")], [By("at", missing_first=True), By("k", falling=True)],
    [By("amount", falling=True, missing_first=False), By("name"), By("day", falling=True), By("k")], [By("k")],
])
def test_cursors_walk_through_the_whole_order(spark, order):
    df = some_rows(spark).cache()
    whole = [tuple(r) for r in df.orderBy(*[b.order() for b in order]).collect()]
    seen, after = [], None
    while part := page(df, order, size=7, after=after).collect():
        seen += [tuple(r) for r in part]
        after = [part[-1][b.column] for b in order]
    assert seen == whole
    # Without a size, all that follows.
    assert rows(page(df, order, after=[whole[29][df.columns.index(b.column)] for b in order])) == sorted(whole[30:], key=repr)


def test_cursor_of_a_row(spark):
    df, order = some_rows(spark), [By("at", falling=True), By("k", falling=True)]
    assert cursor(df.where("k = 7"), order) == (dt.datetime(2024, 1, 2, 1), 7)
    assert cursor(df.where("k = 10"), order) == (None, 10) and cursor(df.where("k < 0"), order) is None
    with pytest.raises(ValueError, match="2 values"):
        beyond(df, order, (1,))
    with pytest.raises(ValueError, match="number"):
        page(df, order, number=2, size=5, after=(None, 1))


@pytest.mark.parametrize(("listing", "order", "source", "key", "shown"), [
    (orders.admin_order_list, orders.NEWEST, "orders", "order_id", "order_id"),
    (orders.customer_order_list, orders.NEWEST, "orders", "order_id", "order_id"),
    (purchases.purchase_list, purchases.PURCHASE_ORDER, "purchases", "purchaseid", "purchaseid"),
    (people.customer_list, people.CUSTOMER_ORDER, "users", "user_id", "id"),
    (people.driver_list, people.DRIVER_ORDER, "partners", "driver_id", "driver_id"),
    (catalogue.catalogue_list, catalogue.CATALOGUE_ORDER, "products", "product_id", "id"),
    (stock.low_stock_list, stock.STOCK_ORDER, "products", "product_id", "id"),
])
def test_every_listing_goes_on_after_a_row(spark, data, listing, order, source, key, shown):
    t = bind(spark, data)
    first = listing(t, number=3, size=3)
    keys = [r[shown] for r in first.collect()]
    last = cursor(getattr(t, source).where(f"{key} in ({','.join(map(str, keys))})"), order)
    by_cursor, by_number = listing(t, size=3, after=last), listing(t, number=4, size=3)
    assert by_number.count() > 0 and rows(by_cursor) == rows(by_number)
    plan = by_cursor._jdf.queryExecution().toString()
    assert "Offset" not in plan and "OFFSET" not in plan


def test_the_condition_reaches_the_scan(spark, data):
    t = bind(spark, data)
    listing = orders.customer_order_list(t, size=20, after=(dt.datetime(1994, 3, 5), 3000))
    plan = listing._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "o_orderdate" in line]
    assert any("LessThan" in line for line in pushed), plan

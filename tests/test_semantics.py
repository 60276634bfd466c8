"""Rules of the operators on small tables written out in full."""

import datetime as dt
from decimal import Decimal as D

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from storelens import Tables
from storelens.functions.columns import hmac_sha256, order_bucket, order_number, pad_number, percent_off
from storelens.operators import catalogue, changes, ingest, invoices, orders, people, pricing, purchases, sales, stock
from storelens.operators import validation
from storelens.operators.numbering import document_number

LEDGER = ("purchase_id int, orderid int, itmid long, line_no int, purchase_date date, instoreid int, outstoreid int,"
          " unitid int, stockqty int, value decimal(12,2), itmcandel int, canordersts int")
PRODUCT = "product_id long, title string, lowstqty int, itmsts int, openbalqty int, openbaldate date"


def movement(item, day, inn, out, qty, cancel=0, order_cancel=0):
    return (1, 1, item, 1, dt.date.fromisoformat(day), inn, out, 0, qty, D("1.00"), cancel, order_cancel)


@pytest.fixture(scope="module")
def store(spark):
    products = spark.createDataFrame([
        (1, "a", 10, 1, 5, None), (2, "b", 10, 1, None, dt.date(2021, 1, 1)), (3, "c", 10, 1, 0, None),
        (4, "d", None, 1, 3, None), (5, "e", 10, 0, 2, None),
    ], PRODUCT)
    ledger = spark.createDataFrame([
        movement(1, "2020-01-01", 1, 0, 4), movement(1, "2019-12-31", 1, 0, 100),
        movement(2, "2021-01-01", 1, 0, 4, None), movement(2, "2020-12-31", 1, 0, 50),
        movement(3, "2022-01-01", 1, 2, 7), movement(3, "2022-01-01", 0, 2, 2, 0, 1), movement(3, "2022-01-02", 0, 0, 9),
        movement(3, "2022-01-02", 1, 0, 9, 1),
    ], LEDGER)
    images = spark.createDataFrame([(1, "b.png"), (1, "a.png")], "product_id long, image_url string")
    return Tables(products=products, ledger=ledger, images=images)


def test_ledger_counts_null_flags_and_takes_in_before_out(store):
    assert rows(stock.stock_ledger(store), "product_id", "stock") == [(1, 9), (2, 4), (3, 7), (4, 3), (5, 2)]


def test_report_skips_null_flags_and_keeps_missing_balance(store):
    got = rows(stock.stock_report(store), "product_id", "in_qty", "out_qty", "current_stock")
    # The row that is in and out counts on both sides, and order cancellation is not looked at.
    assert got == [(1, 4, 0, 9), (2, 0, 0, None), (3, 7, 9, -2), (4, 0, 0, 3), (5, 0, 0, 2)]


def test_stock_states(store):
    low = stock.low_stock_list(store, "low")
    assert rows(low, "id", "stock", "image") == [(1, 9, "a.png"), (2, 4, ""), (3, 7, "")]
    assert stock.low_stock_list(store, "all").count() == 4
    assert stock.low_stock_list(store, "out").count() == 0
    assert rows(stock.low_stock_list(store, "low", size=1, number=2), "id") == [(2,)]
    assert stock.low_stock_total(store, "low", "A").first()[0] == 1


def test_dashboard_tile_counts_the_opening_balance_twice(store):
    # 5 + 9 is over the limit of 10; item 2 has no opening balance.
    assert rows(stock.dashboard_low_stock(store), "id") == [(3,)]


def test_search_is_case_blind_with_wildcards(spark):
    products = spark.createDataFrame([(1, "Rice 5%"), (2, None), (3, "ricer")], "product_id long, title string")
    t = Tables(products=products)
    assert rows(catalogue.title_search(t, "RICE"), "product_id") == [(1,), (3,)]
    assert rows(catalogue.title_search(t, "r_ce"), "product_id") == [(1,), (3,)]
    assert rows(catalogue.title_search(t, ""), "product_id") == [(1,), (3,)]


def test_order_buckets(spark):
    df = spark.createDataFrame([("PENDING",), ("Process",), ("out_for_delivery",), ("cancelled",), ("new",), (None,)], "s string")
    assert [r[0] for r in df.select(order_bucket("s")).collect()] == [
        "processed", "processed", "processed", "cancelled", None, None]
    assert [r[0] for r in df.select(order_bucket("s", True)).collect()] == [
        None, "processed", None, "cancelled", None, None]


def test_numbers_and_references(spark):
    df = spark.createDataFrame([("ORD0043",), ("none",), ("",), (None,), ("12-3",)], "s string")
    assert [r[0] for r in df.select(order_number(F.col("s"))).collect()] == [43, None, None, None, 123]
    df = spark.createDataFrame([(7,), (9999,), (10000,)], "n long")
    assert [r[0] for r in df.select(pad_number(F.col("n"), 4)).collect()] == ["0007", "9999", "10000"]


def test_document_numbers(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "seq long, store long")
    got = rows(document_number(df, "seq", "ORD", 9998, 4, by=["store"]), "store", "seq", "document_no")
    assert got == [(0, 2, "ORD9999"), (0, 4, "ORD10000"), (0, 6, "ORD10001"),
                   (1, 1, "ORD9999"), (1, 3, "ORD10000"), (1, 5, "ORD10001")]
    first = document_number(df, "seq", "PUR", 1, 4, by=["store"], count_from_last=True)
    assert rows(first.where("seq < 3"), "document_no") == [("PUR0001",), ("PUR0001",)]


def test_document_numbers_of_one_store_across_stretches(spark):
    df = spark.range(0, 1 << 18, 1 << 14).withColumnRenamed("id", "seq")
    got = document_number(df, "seq", "N", 0, 1).orderBy("seq").collect()
    assert [r["document_no"] for r in got] == [f"N{i}" for i in range(1, 17)]


def test_missing_members_trim_and_keep_one_null(spark):
    staged = spark.createDataFrame([("x ",), ("x",), (None,), (None,), ("",), (" y",)], "s string")
    master = spark.createDataFrame([(" y ",)], "m string")
    assert rows(catalogue.missing_members(staged, "s", master, "m")) == [("",), ("x",), (None,)]


def test_percent_off_rounds_half_up(spark):
    df = spark.createDataFrame([(D("10.10"), D("5.00")), (D("0.10"), D("5.00"))], "p decimal(10,2), d decimal(5,2)")
    # 9.595 and 0.095 go up.
    assert [r[0] for r in df.select(percent_off(F.col("p"), F.col("d"))).collect()] == [D("9.60"), D("0.10")]


COUPON = ("coupon_id long, coupon_code string, discount_type string, discount_value decimal(10,2),"
          " min_order_value decimal(10,2), max_discount decimal(10,2), expiry_date date, is_active boolean")


@pytest.fixture(scope="module")
def coupons(spark):
    day = dt.date
    table = spark.createDataFrame([
        (1, "P10", "PERCENT", D(10), D(100), None, None, True),
        (2, "CAP", "PERCENT", D(50), D(0), D(20), day(2024, 1, 1), True),
        (3, "FLAT", "FLAT", D(500), D(0), None, None, True),
        (4, "OLD", "FLAT", D(5), D(0), None, day(2023, 12, 31), True),
        (5, "OFF", "FLAT", D(5), D(0), None, None, False),
        (6, "ZERO", "PERCENT", D(50), D(0), D(0), None, True),
    ], COUPON)
    usage = spark.createDataFrame([(1, 7, 1)], "coupon_id long, user_id long, order_id long")
    users = spark.createDataFrame([(7,), (8,)], "user_id long")
    placed = spark.createDataFrame([(1, 7)], "order_id long, user_id long")
    return Tables(coupons=table, coupon_usage=usage, users=users, orders=placed)


def test_coupon_rules_in_order(spark, coupons):
    carts = spark.createDataFrame([
        (1, 8, "p10", D("200.00")), (2, 8, "P10", D("99.99")), (3, 7, "P10", D("200.00")), (4, 8, "cap", D("100.00")),
        (5, 8, "FLAT", D("60.00")), (6, 8, "OLD", D("60.00")), (7, 8, "OFF", D("60.00")), (8, 7, "nope", D("60.00")),
        (9, 7, "P10", D("50.00")), (10, 8, "ZERO", D("10.00")),
    ], "cart_id long, user_id long, coupon_code string, cart_total decimal(12,2)")
    as_of = dt.date(2024, 1, 1)
    got = {r[0]: (r[1], r[2]) for r in pricing.apply_coupon(coupons, carts, as_of).select("cart_id", "reason", "discount").collect()}
    assert got == {
        1: (None, D("20.0000")), 2: ("below_minimum", None), 3: ("used", None), 4: (None, D("20.0000")),
        5: (None, D("500.0000")), 6: ("invalid", None), 7: ("invalid", None), 8: ("invalid", None),
        9: ("below_minimum", None), 10: (None, D("5.0000")),
    }
    pay = {r[0]: tuple(r)[1:] for r in pricing.checkout_price(coupons, carts, as_of).select(
        "cart_id", "first_order_discount", "coupon_discount", "to_pay").collect()}
    # User 8 has no order: the welcome discount comes first and takes the small carts whole.
    assert pay[1] == (D(100), D(20), D(80))
    assert pay[5] == (D(60), D(0), D(0))
    assert pay[4] == (D(100), D(0), D(0))


def test_coupon_marks(coupons):
    assert rows(pricing.coupon_list_with_usage(coupons, 7).where("is_used"), "coupon_id") == [(1,)]
    assert rows(people.first_order_discount(coupons)) == [(7, 0), (8, 100)]


def test_delivery_slots_at_the_edges(spark):
    at = lambda text: dt.datetime.fromisoformat(f"2024-03-05 {text}")
    df = spark.createDataFrame([(1, at("02:10")), (2, at("10:30")), (3, at("10:31")), (4, at("19:30")),
                                (5, at("19:31")), (6, at("20:31")), (7, at("23:45"))], "request_id long, requested_at timestamp_ntz")
    slots = pricing.delivery_slots(df)
    today = slots.where("day = 'Today'").groupBy("request_id").agg(F.count("*"), F.min("label"))
    got = {r[0]: r[1] for r in today.collect()}
    assert got == {1: 18, 2: 10, 3: 9, 4: 1}
    labels = {r[0] for r in slots.where("request_id = 4").select("label").collect()}
    assert "Today, 7:30 pm - 8:30 pm" in labels and "Tomorrow, 10:00 am - 11:00 am" in labels and len(labels) == 11
    assert slots.where("request_id = 7").count() == 10


def test_signatures(spark):
    import hashlib
    import hmac
    df = spark.createDataFrame([("o1", "p1"), ("ö", "₹")], "order_ref string, payment_ref string")
    key = "s3cret"
    good = hmac.new(key.encode(), "o1|p1".encode(), hashlib.sha256).hexdigest()
    other = hmac.new(key.encode(), "ö|₹".encode(), hashlib.sha256).hexdigest()
    signed = df.withColumn("signature", F.when(F.col("order_ref") == "o1", good))
    got = pricing.payment_signature_audit(signed, key)
    assert rows(got, "order_ref", "expected", "is_valid") == [("o1", good, True), ("ö", other, False)]
    with pytest.raises(ValueError):
        hmac_sha256(F.lit("x"), "k" * 65)


def test_address_components(spark):
    text = ('[{"types":["route"],"long_name":"Market Road"},{"types":["political","locality"],"long_name":"Pune"},'
            '{"types":["postal_code"],"long_name":"411001"}]')
    df = spark.createDataFrame([(1, text), (2, "[]"), (3, None)], "document_id long, components string")
    assert rows(pricing.address_components(df)) == [
        (1, "Market Road", "Pune", "Pune", "411001"), (2, "", "", "", ""), (3, "", "", "", "")]


def test_validation_gives_the_first_reason(spark):
    df = spark.createDataFrame([(" ", "1"), ("a", None), ("a", "123"), ("a", "0123456789"), ("a", "0123456789\n")], "name string, phone string")
    checked = validation.check_addresses(df)
    assert [r["reason"] for r in checked.collect()][:4] == [
        "Name is required", "Phone number is required", "Phone number must be exactly 10 digits", None]
    fine, refused = validation.split(checked.limit(4))
    assert fine.count() == 1 and refused.count() == 3


def test_address_book_puts_missing_values_first(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    df = spark.createDataFrame([
        (1, 1, "a", False, day(3)), (1, 2, "b", True, day(1)), (1, 3, "c", None, day(1)), (1, 4, "d", False, None),
    ], "user_id long, address_id long, name string, is_default boolean, created_at timestamp_ntz")
    got = people.address_book(Tables(addresses=df)).orderBy("position")
    assert [r["address_id"] for r in got.collect()] == [3, 2, 4, 1]
    assert people.newest_address_by_time(df, "name").first()["name"] == "d"
    assert people.latest_address_per_user(df, "name").first()["name"] == "d"


ORDER = ("order_id long, order_no string, user_id long, total_amount decimal(12,2), order_status string,"
         " payment_status string, created_at timestamp_ntz")


@pytest.fixture(scope="module")
def shop(spark):
    noon = dt.datetime(2024, 1, 31, 12)
    placed = spark.createDataFrame([
        (1, "A1", 1, D(10), "Pending", "complete", noon), (2, "A2", 1, D(20), "delivered", "complete", noon - dt.timedelta(days=1)),
        (3, "A3", 2, D(30), "cancelled", "complete", noon), (4, "A4", 3, D(40), "new", "pending", None),
    ], ORDER)
    items = spark.createDataFrame([(1, 5, 1, 2), (1, 6, 2, 3), (2, 5, 1, 1)], "order_id long, product_id long, line_no int, product_qty int")
    addresses = spark.createDataFrame([
        (1, 1, "home", "1", None), (2, 1, "home", "2", None), (3, 1, "work", "3", "x"), (4, 2, None, "4", None),
    ], "address_id long, user_id long, name string, phone string, full_address string")
    payments = spark.createDataFrame([(1, "COD"), (1, "COD"), (1, "UPI"), (2, "UPI")], "order_id long, method string")
    tracking = spark.createDataFrame([(1, noon), (1, noon), (2, noon)], "order_id long, created_at timestamp_ntz")
    return Tables(orders=placed, order_items=items, addresses=addresses, payments=payments, tracking=tracking)


def test_item_count_is_multiplied_by_equal_address_names(shop):
    got = rows(orders.user_orders(shop), "order_id", "name", "item_count", "bucket")
    assert got == [(1, "home", 10, "processed"), (1, "work", 5, "processed"), (2, "home", 2, "delivered"),
                   (2, "work", 1, "delivered"), (3, None, 0, "cancelled")]


def test_history_is_multiplied_by_payments_and_tracking(shop):
    got = rows(orders.user_order_history(shop), "order_id", "method", "items")
    assert got == [(1, "COD", 20), (1, "UPI", 10), (2, "UPI", 1)]


def test_recent_orders_put_a_missing_time_first(shop):
    got = [tuple(r) for r in orders.recent_orders(shop, 3).select("order_id", "customer", "items").collect()]
    assert sorted(got, key=repr) == [(1, "home", 4), (3, None, 0), (4, None, 0)]


def test_reorder_counts(spark, shop):
    t = shop.replace(products=spark.createDataFrame([(5,)], "product_id long"))
    assert rows(orders.reorder_items(t)) == [(1, 1, 1), (2, 1, 0)]


def test_day_figures_without_sales_are_null(shop):
    got = sales.today_vs_yesterday(shop, dt.date(2024, 1, 31)).first().asDict()
    assert got == {"today_orders": 1, "today_revenue": D(10), "today_pending": 1,
                   "yesterday_orders": 1, "yesterday_revenue": D(20), "yesterday_pending": 0}
    empty = sales.today_vs_yesterday(shop, dt.date(2020, 1, 1)).first().asDict()
    assert empty["today_revenue"] is None and empty["today_orders"] == 0


def test_charts(shop):
    week = sales.chart_gap_fill(shop, "Week", dt.date(2024, 1, 31)).orderBy("position")
    assert [(r["name"], r["sales"]) for r in week.collect()] == [
        ("Mon", 0), ("Tue", 20), ("Wed", 10), ("Thu", 0), ("Fri", 0), ("Sat", 0), ("Sun", 0)]
    month = sales.chart_gap_fill(shop, "Month", dt.date(2024, 1, 2)).orderBy("position")
    assert [r["sales"] for r in month.collect()] == [0, 0, 0, 0, 30]
    assert sales.chart_gap_fill(shop, "week", dt.date(2024, 1, 31)) is None


def test_purchase_filter_refuses_a_backward_range(spark):
    with pytest.raises(ValueError):
        purchases.purchase_filter("", dt.date(2024, 1, 2), dt.date(2024, 1, 1))


def test_cancelled_purchase_lines_leave_the_header(spark):
    headers = spark.createDataFrame([(1, "P1", None, dt.date(2024, 1, 1), 0, 1), (2, "P2", "r", dt.date(2024, 1, 2), 1, 1)],
                                    "purchaseid int, purchase_no string, refrence string, purchasedate date, cansts int, storeid int")
    ledger = spark.createDataFrame([movement(1, "2024-01-01", 1, 0, 1, 1)], LEDGER)
    got = purchases.purchase_list(Tables(purchases=headers, ledger=ledger))
    assert rows(got, "purchaseid", "date", "refrence", "status", "totamt") == [
        (1, "01-01-2024", "", "Active", None), (2, "02-01-2024", "r", "Cancelled", None)]


def test_tenants(spark):
    t = Tables(tenants=spark.createDataFrame([(1, "s")], "register_id int, store_name string"),
               users=spark.createDataFrame([(5, 1), (6, 2)], "user_id long, register_id int"))
    assert rows(catalogue.tenant_scan(t, "users"), "user_id") == [(5,)]
    assert rows(catalogue.tenant_scan(t, "users", 1), "user_id") == [(5,)]
    with pytest.raises(LookupError):
        catalogue.tenant_scan(t, "users", 2)
    with pytest.raises(AttributeError):
        t.orders
    with pytest.raises(ValueError):
        Tables(nothing=None)


def test_tables_of_one_store(spark, data):
    from storelens.sources.binding import bind
    from storelens.sources.tables import TABLE_NAMES
    from storelens.sources.tenancy import store_tables

    t = bind(spark, data)
    stores = [r[0] for r in t.tenants.select("register_id").collect()]
    cut = [store_tables(t, n) for n in stores[:3]]
    for name in TABLE_NAMES:
        whole = getattr(t, name)
        parts = [getattr(c, name) for c in cut]
        assert all(p.columns == whole.columns for p in parts)
        if name in ("orders", "order_items", "payments", "addresses", "cart", "users"):
            assert 0 < sum(p.count() for p in parts) < whole.count()
    with pytest.raises(LookupError):
        store_tables(t, 999)


def test_flash_sale_bounds_count(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    t = Tables(
        flash_sales=spark.createDataFrame([(1, 9, noon, noon), (2, 9, noon + dt.timedelta(hours=1), noon + dt.timedelta(hours=2))],
                                          "flsh_trnid long, register_id int, from_datetime timestamp_ntz, to_datetime timestamp_ntz"),
        flash_sale_lines=spark.createDataFrame([(1, 3, D(5)), (2, 3, D(6))], "flsh_trnid long, product_id long, product_rate decimal(10,2)"),
        products=spark.createDataFrame([(3, "x")], "product_id long, title string"))
    assert rows(catalogue.flash_sale_items(t, 9, noon), "flsh_trnid") == [(1,)]
    assert catalogue.flash_sale_items(t, 8, noon).count() == 0


def test_partner_delivery_settles_cash_only(spark):
    placed = spark.createDataFrame([(1, "Pending", "pending"), (2, "Pending", "pending")], "order_id long, order_status string, payment_status string")
    paid = spark.createDataFrame([(1, "cod", "PENDING"), (2, "UPI", "x")], "order_id long, method string, status string")
    events = spark.createDataFrame([(1, 1, "out_for_delivery", False), (2, 1, "delivered", True), (3, 2, "delivered", False)],
                                   "seq long, order_id long, state string, by_partner boolean")
    after, settled, steps = changes.order_state_apply(placed, paid, events)
    # The second order was not out, so its user's word for the delivery doesn't count.
    assert rows(after) == [(1, "delivered", "complete"), (2, "Pending", "pending")]
    assert rows(settled) == [(1, "cod", "complete"), (2, "UPI", "x")]
    assert rows(steps, "order_id", "status") == [(1, "out_for_delivery")]
    more = spark.createDataFrame([(1, 1, "out_for_delivery", None), (2, 1, "delivered", None), (3, 1, "delivered", False),
                                  (70_000_000, 2, "out_for_delivery", False), (90_000_000, 2, "delivered", False),
                                  (5, 99, "delivered", None)], "seq long, order_id long, state string, by_partner boolean")
    after, _, steps = changes.order_state_apply(placed, paid, more)
    assert rows(after, "order_id", "order_status") == [(1, "delivered"), (2, "delivered")]
    assert rows(steps, "seq") == [(1,), (2,), (70_000_000,), (90_000_000,)]


def test_attempts_without_code_or_user(spark):
    form = "user_id long, at timestamp_ntz, seq long, code long"
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    issued = spark.createDataFrame([(1, at(0), 1, 7), (2, at(0), 2, None)], form)
    tried = spark.createDataFrame([(1, at(1), 3, None), (1, at(2), 4, 7), (2, at(1), 5, None), (None, at(1), 6, 7)], form)
    got = pricing.otp_match(issued, tried)
    assert rows(got, "seq", "outcome") == [(3, "wrong_code"), (4, "matched"), (5, "wrong_code"), (6, "no_code")]


def test_partial_address_update_tells_absent_from_null(spark):
    now = spark.createDataFrame([(1, 5, "a", "x"), (2, 5, "b", "y"), (3, 5, "c", "z")], "address_id long, user_id long, name string, street string")
    batch = spark.createDataFrame([
        (1, "update", 1, 5, ["street"], "ignored", None), (2, "update", 1, 5, ["name"], "A", "ignored"),
        (3, "delete", 2, 5, [], None, None), (4, "delete", 3, 6, [], None, None), (5, "insert", 9, 6, [], "n", "s"),
    ], "seq long, op string, address_id long, user_id long, given array<string>, name string, street string")
    got = changes.address_apply_changes(now, batch, ["name", "street"])
    assert rows(got) == [(1, 5, "A", None), (3, 5, "c", "z"), (9, 6, "n", "s")]


def test_bulk_load_defaults(spark):
    t = Tables(
        categories=spark.createDataFrame([(4, "Food")], "categories_id int, categories_name string"),
        units=spark.createDataFrame([(2, "KG")], "unitid int, unitshortcode string"),
        products=spark.createDataFrame([(10, "Rice"), (11, None)], "product_id long, title string"))
    sheet = spark.createDataFrame([
        (1, " Rice ", "Food", None, None, None, None, "KG"), (2, "Dal", " Food", None, None, None, None, " KG "),
        (3, "Dal", "New", "d", D(2), D(3), 4, None),
    ], "trnid long, title string, categoriesname string, description string, price decimal(10,2), mrp decimal(10,2), quantity int, unit string")
    got = ingest.bulk_item_load(t, sheet)
    assert rows(got["categories"], "categories_id", "categories_name") == [(5, "New")]
    assert rows(got["units"], "unitid", "unitshortcode") == [(3, "")]
    assert rows(got["products"], "product_id", "title", "categories_id", "unit", "price", "description") == [
        (12, "Dal", 4, 2, D("0.00"), ""), (13, "Dal", 5, 3, D("2.00"), "d")]


def test_invoice_link_is_percent_encoded(spark):
    t = Tables(
        orders=spark.createDataFrame([(1, "A1", 1, D("10.00"), dt.datetime(2024, 1, 1))],
                                     "order_id long, order_no string, user_id long, total_amount decimal(12,2), created_at timestamp_ntz"),
        addresses=spark.createDataFrame([(1, 1, "n", "p", "12 A&B (x)~é/+")], "address_id long, user_id long, name string, phone string, full_address string"),
        order_items=spark.createDataFrame([(1, 1, 7, "Tea", 2, D("5.00")), (1, 2, 8, "Rice", 1, D("5.00"))],
                                          "order_id long, line_no int, product_id long, product_name string, product_qty int, product_amount decimal(12,2)"))
    got = invoices.invoice_text(t).first()
    assert got["items_text"] == "1. Tea  x2  ₹5.00\n2. Rice  x1  ₹5.00"
    assert got["link"].endswith("query=12%20A%26B%20(x)~%C3%A9%2F%2B") and got["kind"] == "delivery"
    short = invoices.invoice_text(t, page_rows=1)
    assert rows(short, "page_no", "items_text") == [(0, "1. Tea  x2  ₹5.00"), (1, "2. Rice  x1  ₹5.00")]

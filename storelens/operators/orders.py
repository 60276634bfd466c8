"""Order listings, details and documents.

Joins that multiply rows in a plain query (several addresses, payments or
tracking rows to one order) are written with the multiplicity counted first:
the sums come out the same and the intermediate result stays at one row per
result row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import order_bucket
from storelens.functions.keyed import By, documents, latest, moment_of, only_shown, page, ranked, spread_join, stretch
from storelens.operators.people import latest_address_per_user
from storelens.sources.tables import Tables

# Order of the listings.
NEWEST = [By("created_at", falling=True), By("order_id", falling=True)]


def _lookup(df: DataFrame, lookup: DataFrame, key: str, by: str, size: int | None) -> DataFrame:
    """Lookup for a page, or for a whole table in which a key may be hot."""
    return df.join(lookup, key, "left") if size is not None else spread_join(df, lookup, [key], [by])


def order_item_count(t: Tables) -> DataFrame:
    """Quantity ordered per order, zero for an order without lines."""
    return t.orders.select("order_id").join(_quantities(t.order_items), "order_id", "left").select(
        "order_id", F.coalesce("item_count", F.lit(0)).alias("item_count")
    )


def _quantities(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.sum("product_qty").alias("item_count"))


def admin_order_list(t: Tables, number: int = 1, size: int | None = None, after: Sequence | None = None) -> DataFrame:
    """Orders of known delivery mode with customer name and item count, newest first. ``after``: cursor in ``NEWEST``."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    orders = t.orders.join(t.delivery_modes, "delivery_id")
    shown = page(orders, NEWEST, number, size, after)
    names = latest_address_per_user(only_shown(t.addresses, shown, "user_id", size), "name")
    counts = _quantities(only_shown(t.order_items, shown, "order_id", size))
    named = _lookup(shown, names, "user_id", "order_id", size)
    return named.join(counts, "order_id", "left").select(
        "order_id", "order_no", "total_amount", "order_status", "payment_status", "delivery_mode", "name",
        F.date_format("delivery_start", stamp).alias("delivery_start"),
        F.date_format("delivery_end", stamp).alias("delivery_end"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
    )


def customer_order_list(t: Tables, number: int = 1, size: int | None = None, after: Sequence | None = None) -> DataFrame:
    """Orders with customer name, review rating and item count, newest first. ``after``: cursor in ``NEWEST``."""
    shown = page(t.orders, NEWEST, number, size, after)
    names = latest_address_per_user(
        only_shown(t.addresses, shown, "user_id", size), F.col("name").alias("customer_name")
    )
    counts = _quantities(only_shown(t.order_items, shown, "order_id", size))
    ratings = only_shown(t.reviews, shown, "user_id", size).select("user_id", "rating")
    return (
        _lookup(shown, names.join(ratings, "user_id", "full"), "user_id", "order_id", size)
        .join(counts, "order_id", "left")
        .select(
            "order_id", "order_no", "total_amount", "order_status", "payment_status", "rating",
            "created_at", "customer_name", F.coalesce("item_count", F.lit(0)).alias("item_count"),
        )
    )


def user_orders(t: Tables, case_sensitive: bool = False) -> DataFrame:
    """Orders under their screen, one row per address name of the user.

    The item count is multiplied by the number of addresses of that name.
    """
    names = t.addresses.groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("_same"))
    shown = t.orders.withColumn("bucket", order_bucket("order_status", case_sensitive)).where(F.col("bucket").isNotNull())
    return (
        spread_join(shown, names, ["user_id"], ["order_id"])
        .join(_quantities(t.order_items), "order_id", "left")
        .select(
            "order_id", "user_id", "order_no", "total_amount", "order_status", "payment_status", "bucket", "name",
            (F.coalesce("item_count", F.lit(0)) * F.coalesce("_same", F.lit(1))).alias("item_count"),
        )
    )


def user_orders_plain(t: Tables) -> DataFrame:
    """Orders under their screen by exact status text, without addresses."""
    return (
        t.orders.withColumn("bucket", order_bucket("order_status", case_sensitive=True))
        .where(F.col("bucket").isNotNull())
        .join(_quantities(t.order_items), "order_id", "left")
        .select("order_id", "user_id", "total_amount", "order_status", "bucket",
                F.coalesce("item_count", F.lit(0)).alias("item_count"))
    )


def order_items_detail(t: Tables) -> DataFrame:
    """Order lines with unit name; lines of an unknown unit are left out."""
    return t.order_items.join(t.units, F.col("product_unit") == F.col("unitid")).select(
        "order_id", "line_no", F.col("product_name").alias("itmname"), F.col("product_rate").alias("price"),
        F.col("product_qty").alias("qty"), F.col("product_amount").alias("total"), F.col("unitname").alias("unit"),
    )


def _payment_methods(payments: DataFrame) -> DataFrame:
    """Methods of each order with the number of payments made by them."""
    return payments.groupBy("order_id", "method").agg(F.count(F.lit(1)).alias("_same"))


def order_header_detail(t: Tables, role: str = "user", one_method: bool = False) -> DataFrame:
    """Order header with customer, payment method and item total, one row per method.

    Orders without lines or without an address are left out, and payments of
    one method multiply the item total, as in the per-order query.
    ``one_method`` keeps the first method by name only.
    """
    orders = t.orders
    if role == "delivery_partner":
        orders = orders.where(F.col("order_status") == "out_for_delivery")
    totals = t.order_items.groupBy("order_id").agg(F.sum("product_amount").alias("_amount"))
    methods = _payment_methods(t.payments)
    if one_method:
        methods = methods.groupBy("order_id").agg(F.min(F.struct("method", "_same")).alias("m")).select("order_id", "m.*")
    customer = latest_address_per_user(
        t.addresses, F.col("name").alias("customer_name"), F.col("phone").alias("customer_phone")
    )
    return (
        spread_join(orders, customer, ["user_id"], ["order_id"], "inner")
        .join(totals, "order_id")
        .join(methods, "order_id", "left")
        .select(
            "order_id", "order_no", "order_status", "total_amount", "handling_fee", "delivery_fee",
            F.col("coupon_discount").alias("discount_amount"), "coupon_code", "customer_name", "customer_phone",
            F.col("address_delivery").alias("address"),
            F.coalesce("method", F.lit("COD")).alias("pay_method"),
            (F.col("_amount") * F.coalesce("_same", F.lit(1))).cast("decimal(18,2)").alias("item_total"),
        )
    )


def line_documents(headers: DataFrame, lines: DataFrame, item: Callable[[Column, Column], Column], page_rows: int,
                   name: str) -> DataFrame:
    """Order headers with the list of their lines, page by page."""
    return documents(
        headers, lines, "order_id", ["line_no", "product_id", "product_qty", "product_amount"],
        {"_line": F.coalesce("line_no", F.lit(-1)), "_product": F.coalesce(stretch("product_id", 10), F.lit(-1))},
        item, page_rows, name,
    )


def order_document(t: Tables, page_rows: int = 1000) -> DataFrame:
    """Nested document per order: customer, bill, payment and its lines.

    Lines come in lists of at most ``page_rows``; a longer order is several
    documents, told apart by ``page_no``.
    """
    lines = t.order_items.join(t.units, F.col("product_unit") == F.col("unitid")).select(
        "order_id", "line_no", "product_id", "product_name", "product_rate", "product_qty", "product_amount", "unitname"
    )

    def item(row: Column, _: Column) -> Column:
        return F.struct(
            row["product_name"].alias("itmname"), row["product_rate"].alias("price"), row["product_qty"].alias("qty"),
            row["product_amount"].alias("total"), row["unitname"].alias("unit"),
        )

    zero = F.lit(0).cast("decimal(10,2)")
    header = order_header_detail(t, one_method=True)
    return line_documents(header, lines, item, page_rows, "itmdetails").select(
        "order_id", "page_no", "order_no", "address",
        F.struct(F.col("customer_name").alias("name"), F.col("customer_phone").alias("phone")).alias("customer"),
        F.struct(
            F.coalesce("item_total", zero).alias("item_total"),
            F.coalesce("handling_fee", zero).alias("handling_fee"),
            F.coalesce("delivery_fee", zero).alias("delivery_fee"),
            F.coalesce("discount_amount", zero).alias("discount"),
            F.coalesce("total_amount", zero).alias("total_amount"),
            F.nullif("coupon_code", F.lit("")).alias("coupon_code"),
        ).alias("billdetails"),
        F.struct(F.col("pay_method").alias("pay_mode")).alias("paydetails"),
        "itmdetails",
    )


def recent_orders(t: Tables, size: int = 5) -> DataFrame:
    """Newest order rows, one per address name of the user, with their line count.

    Every order gives at least one row, so the newest ``size`` rows are found
    among the newest ``size`` orders and all else reads only those.
    """
    newest = t.orders.orderBy(*[b.order() for b in NEWEST]).limit(size)
    names = (
        only_shown(t.addresses, newest, "user_id", size)
        .groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("_same"))
    )
    counts = (
        only_shown(t.order_items, newest, "order_id", size)
        .groupBy("order_id").agg(F.count("product_id").alias("_lines"))
    )
    return (
        newest.join(names, "user_id", "left").join(counts, "order_id", "left")
        .orderBy(*[b.order() for b in NEWEST], F.col("name").asc_nulls_first())
        .limit(size)
        .select(
            "order_id", "order_no", "total_amount", "order_status", F.col("name").alias("customer"),
            (F.coalesce("_lines", F.lit(0)) * F.coalesce("_same", F.lit(1))).alias("items"),
        )
    )


def user_order_history(t: Tables) -> DataFrame:
    """One row per order, payment method and tracking time.

    The item sum is multiplied by the payments of the method and by the
    tracking rows of the time.
    """
    paid = t.payments.groupBy("order_id", "method").agg(F.count(F.lit(1)).alias("_paid"))
    tracked = (
        t.tracking.groupBy("order_id", F.col("created_at").alias("tracked_at"))
        .agg(F.count(F.lit(1)).alias("_tracked"))
    )
    ordered = (
        t.orders.select("order_id", "order_no", "user_id", "total_amount", "order_status")
        .join(paid, "order_id")
        .join(_quantities(t.order_items), "order_id", "left")
    )
    return (
        spread_join(tracked, ordered, ["order_id"], ["tracked_at"], "inner")
        .select(
            "order_id", "order_no", "user_id", "total_amount", "method", "order_status", "tracked_at",
            (F.coalesce("item_count", F.lit(0)) * F.col("_paid") * F.col("_tracked")).alias("items"),
        )
    )


def delivery_order_detail(t: Tables) -> DataFrame:
    """What a delivery partner sees of an order: latest address, payment method."""
    customer = latest_address_per_user(t.addresses, "name", "phone", F.col("full_address").alias("address"))
    method = t.payments.groupBy("order_id").agg(F.min("method").alias("method"))
    orders = t.orders.select("order_id", "order_no", "user_id")
    return (
        spread_join(orders, customer, ["user_id"], ["order_id"], "inner")
        .join(method, "order_id")
        .select("order_id", "order_no", "name", "phone", "address", "method")
    )


def user_delivery_detail(t: Tables) -> DataFrame:
    """The same keyed by user: the newest order with the latest address."""
    newest = latest(t.orders, ["user_id"], [F.col("created_at").isNull(), "created_at", "order_id"], ["order_id"])
    customer = latest_address_per_user(t.addresses, "name", "phone", "full_address")
    return newest.join(customer, "user_id")


def tracking_timeline(t: Tables) -> DataFrame:
    """Status steps of each order in time order."""
    steps = t.tracking.select("order_id", "id", F.lower("status").alias("status"), "created_at")
    return ranked(
        steps, by=["order_id"], order=[F.col("created_at").asc_nulls_last(), F.col("id")],
        bucket={"_moment": F.coalesce(moment_of("created_at"), F.lit(2 ** 62)), "_stretch": stretch("id")},
    ).drop("id")


def reorder_items(t: Tables) -> DataFrame:
    """Lines of each order whose product still exists (added) or is gone (skipped)."""
    known = t.products.select("product_id").withColumn("_known", F.lit(True))
    # Lines of one order and product are counted before they meet the products.
    lines = t.order_items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("_lines"))
    return (
        lines.join(known, "product_id", "left")
        .groupBy("order_id")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_known"), F.col("_lines"))), F.lit(0)).alias("added"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_lines"))), F.lit(0)).alias("skipped"),
        )
    )


def reorder_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Order lines that can be put into the cart again, and those that cannot."""
    lines = t.order_items.select("order_id", "product_id", "product_qty")
    return (
        lines.join(t.products, "product_id", "left_semi"),
        lines.join(t.products, "product_id", "left_anti"),
    )

"""Listings, charts, searches and price rules as registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import hmac_sha256, order_bucket, pad_number
from storelens.operators import catalogue, invoices, orders, people, pricing, purchases, sales, stock, validation
from storelens.plans.dashboard import dashboard_rows
from storelens.plans.registered import AS_OF, OPEN_DATE, query, star_query
from storelens.plans.session import scratch_folder
from storelens.sources.binding import StarSchema
from storelens.sources.layout import stored_tables, write_by_store
from storelens.sources.readers import table_source
from storelens.sources.snapshots import bring_forward, snapshot_ledger
from storelens.sources.tables import Tables
from storelens.sources.tenancy import store_tables

# --- sources and predicates -------------------------------------------------

STORE_NO = 7
query("tenant_scan_orders")(lambda t: catalogue.tenant_scan(t, "orders", STORE_NO).select("order_id", "user_id"))
query("tenant_scan_ledger")(lambda t: catalogue.tenant_scan(t, "ledger", STORE_NO).groupBy("itmid").agg(
    F.count(F.lit(1)).alias("rows"), F.sum("stockqty").alias("qty")))
query("tenant_stock_ledger")(lambda t: stock.stock_ledger(store_tables(t, STORE_NO), OPEN_DATE))


@star_query("stored_stock_ledger")
def _stored_stock_ledger(star: StarSchema) -> DataFrame:
    """The tables laid out by store, and the stock ledger of one store from its own files."""
    names = ("tenants", "products", "purchases", "ledger")
    folder = scratch_folder(star.spark, "by-store")
    write_by_store(star.tables(), folder, names)
    return stock.stock_ledger(stored_tables(star.spark, folder, STORE_NO, names), OPEN_DATE)


@star_query("stock_ledger_snapshot")
def _snapshot_ledger(star: StarSchema) -> DataFrame:
    """The stock ledger from sums kept beside it, after more lines came to it."""
    t = star.tables()
    folder = scratch_folder(star.spark, "ledger")
    columns = t.ledger.select("itmid", "purchase_date", "instoreid", "outstoreid", "itmcandel", "canordersts", "stockqty")
    columns.where("itmid % 5 <> 0").write.parquet(f"{folder}/rows")
    bring_forward(star.spark, f"{folder}/rows", f"{folder}/sums", columns.schema)
    columns.where("itmid % 5 = 0 or itmid is null").write.mode("append").parquet(f"{folder}/rows")
    return stock.stock_ledger(t.replace(ledger=snapshot_ledger(star.spark, f"{folder}/rows", f"{folder}/sums", columns.schema)), OPEN_DATE)


query("tenant_admin_order_list")(lambda t: orders.admin_order_list(store_tables(t, STORE_NO)))
query("tenant_customer_list")(lambda t: people.customer_list(store_tables(t, STORE_NO)))
query("tenant_cart_bill")(lambda t: pricing.cart_bill(store_tables(t, STORE_NO), 5, 25))
query("tenant_scan")(lambda t: catalogue.tenant_scan(t, "users").select("user_id", "register_id", "store_name"))
query("title_search")(lambda t: catalogue.title_search(t, "re_ "))
query("purchase_search")(lambda t: purchases.purchase_search(
    t, "1", dt.date(1997, 2, 1), dt.date(1998, 6, 30)).select("purchaseid", "purchase_no", "purchasedate"))
query("category_filter")(lambda t: catalogue.category_filter(t))
query("unit_list")(lambda t: catalogue.unit_list(t))
query("active_coupons")(lambda t: pricing.active_coupons(t.coupons, AS_OF).select("coupon_id", "coupon_code", "expiry_date"))
query("status_label")(lambda t: catalogue.product_status(t))
query("order_bucket")(lambda t: t.orders.select(
    "order_id", order_bucket("order_status").alias("bucket"),
    order_bucket("order_status", case_sensitive=True).alias("exact_bucket")).where("bucket is not null"))
query("product_options")(lambda t: catalogue.product_options(t))
query("normalize_order_id")(lambda t: pricing.normalize_order_id(t))


@star_query("table_source")
def _table_source(star: StarSchema) -> DataFrame:
    return table_source(star.spark, f"{star.folder}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")


@query("row_validation_addresses")
def _check_addresses(t: Tables) -> DataFrame:
    phone = F.when(F.col("address_id") % 5 == 0, F.lit("12-34")).when(F.col("address_id") % 7 != 0, F.col("phone"))
    rows = t.addresses.select(
        "address_id", F.when(F.col("address_id") % 9 != 0, F.col("name")).otherwise("  ").alias("name"),
        phone.alias("phone"))
    return validation.check_addresses(rows).select("address_id", "reason")


@query("row_validation_orders")
def _check_orders(t: Tables) -> DataFrame:
    key = F.col("order_id")
    rows = t.orders.select(
        "order_id", F.when(key % 6 != 0, F.col("address_delivery")).otherwise("").alias("address_delivery"),
        F.when(key % 7 == 0, "Immediate").when(key % 5 != 0, F.col("delivery_start").cast("string"))
        .alias("delivery_start"))
    return validation.check_orders(rows).select("order_id", "reason")


@query("row_validation_items")
def _check_items(t: Tables) -> DataFrame:
    key = F.col("product_id")
    rows = t.products.select(
        "product_id", F.when(key % 4 != 0, F.col("title")).alias("name"),
        F.when(key % 5 != 0, F.col("category")).alias("category"), F.nullif("unit", F.lit(3)).alias("unit"))
    return validation.check_items(rows).select("product_id", "reason")


@query("row_validation_coupons")
def _check_coupons(t: Tables) -> DataFrame:
    key = F.col("coupon_id")
    rows = t.coupons.select(
        "coupon_id", F.when(key % 4 != 0, F.col("coupon_code")).alias("coupon_code"),
        F.when(key % 5 == 0, "GIFT").otherwise(F.col("discount_type")).alias("discount_type"), "discount_value")
    return validation.check_coupons(rows).select("coupon_id", "reason")


# --- stock ------------------------------------------------------------------

query("stock_ledger")(lambda t: stock.stock_ledger(t, OPEN_DATE))
query("stock_report")(lambda t: stock.stock_report(t, "all", OPEN_DATE))
query("stock_report_in")(lambda t: stock.stock_report(t, "in", OPEN_DATE))
query("stock_report_out")(lambda t: stock.stock_report(t, "out", OPEN_DATE))
query("stock_state_filter")(lambda t: stock.stock_state_filter(stock.stock_ledger(t, OPEN_DATE), "out"))
query("low_stock_list")(lambda t: stock.low_stock_list(t, "low", default_open_date=OPEN_DATE))
query("low_stock_page")(lambda t: stock.low_stock_list(t, "low", "ring", 2, 15, OPEN_DATE))
query("low_stock_total")(lambda t: stock.low_stock_total(t, "low", "ring", OPEN_DATE))
query("dashboard_low_stock")(lambda t: stock.dashboard_low_stock(t, default_open_date=OPEN_DATE))
query("first_image_per_product")(lambda t: stock.first_image_per_product(t.images))

# --- sales ------------------------------------------------------------------

query("sales_week")(lambda t: sales.sales_week(t, AS_OF))
query("sales_month")(lambda t: sales.sales_month(t, AS_OF))
query("sales_year")(lambda t: sales.sales_year(t, dt.date(2000, 7, 31)))
query("chart_gap_fill_week")(lambda t: sales.chart_gap_fill(t, "Week", AS_OF))
query("chart_gap_fill_month")(lambda t: sales.chart_gap_fill(t, "Month", dt.date(1999, 2, 10)))
query("chart_gap_fill_year")(lambda t: sales.chart_gap_fill(t, "Year", AS_OF))
query("revenue_graph")(lambda t: sales.revenue_graph(t, dt.datetime(2001, 8, 1, 9, 30)))
query("dashboard_totals")(lambda t: sales.dashboard_totals(t, "complete"))
query("today_vs_yesterday")(lambda t: sales.today_vs_yesterday(t, dt.date(2001, 7, 15)))
query("dashboard_bundle")(lambda t: dashboard_rows(t, "Month", AS_OF, OPEN_DATE))



def _stores(t: Tables) -> Tables:
    """Orders with the store of their user."""
    return t.replace(orders=t.orders.join(t.users.select("user_id", "register_id"), "user_id"))


STORE = ("register_id",)
query("sales_year_by_store")(lambda t: sales.sales_year(_stores(t), dt.date(2000, 7, 31), by=STORE))
query("chart_gap_fill_by_store")(lambda t: sales.chart_gap_fill(_stores(t), "Week", AS_OF, by=STORE))
query("revenue_graph_by_store")(lambda t: sales.revenue_graph(_stores(t), dt.datetime(2001, 8, 1, 9, 30), STORE))
query("dashboard_totals_by_store")(lambda t: sales.dashboard_totals(_stores(t), "complete", by=STORE))
query("today_vs_yesterday_by_store")(lambda t: sales.today_vs_yesterday(_stores(t), dt.date(2001, 7, 15), by=STORE))

# --- orders and people --------------------------------------------------------

query("admin_order_list")(lambda t: orders.admin_order_list(t))
query("paged_sort")(lambda t: orders.admin_order_list(t, 3, 20))
# Pages far in, after a row whose values the caller has seen.
LAST_SEEN = (dt.datetime(1994, 3, 5), 3000)
query("paged_sort_after")(lambda t: orders.admin_order_list(t, size=20, after=LAST_SEEN))
query("customer_order_after")(lambda t: orders.customer_order_list(t, size=20, after=LAST_SEEN))
query("customer_order_list")(lambda t: orders.customer_order_list(t))
query("customer_order_page")(lambda t: orders.customer_order_list(t, 1, 20))
query("user_orders")(lambda t: orders.user_orders(t))
query("user_orders_plain")(lambda t: orders.user_orders_plain(t))
query("order_items_detail")(lambda t: orders.order_items_detail(t))
query("order_header_detail")(lambda t: orders.order_header_detail(t))
query("order_header_partner")(lambda t: orders.order_header_detail(t, "delivery_partner"))
query("recent_orders")(lambda t: orders.recent_orders(t))
query("user_order_history")(lambda t: orders.user_order_history(t))
query("order_item_count")(lambda t: orders.order_item_count(t))
query("delivery_order_detail")(lambda t: orders.delivery_order_detail(t))
query("user_delivery_detail")(lambda t: orders.user_delivery_detail(t))
query("tracking_timeline")(lambda t: orders.tracking_timeline(t))

def some_gone(t: Tables) -> Tables:
    """Orders some of whose products have left the catalogue."""
    gone = F.when(F.col("product_id") % 10 == 0, F.col("product_id") + 10000000).otherwise(F.col("product_id"))
    return t.replace(order_items=t.order_items.withColumn("product_id", gone))


query("reorder_items")(lambda t: orders.reorder_items(some_gone(t)))
query("customer_order_summary")(lambda t: people.order_summary(t.orders))
query("customer_list")(lambda t: people.customer_list(t, "i"))
query("customer_page")(lambda t: people.customer_list(t, "", 2, 10))
query("customer_page_after")(lambda t: people.customer_list(t, "", size=10, after=(40,)))
query("customer_directory")(lambda t: people.customer_directory(t))
query("customer_details")(lambda t: people.customer_details(t))
query("latest_address_per_user")(lambda t: people.latest_address_per_user(t.addresses))
query("newest_address_by_time")(lambda t: people.newest_address_by_time(t.addresses))
query("address_book")(lambda t: people.address_book(t))
query("review_status")(lambda t: people.review_status(t))
query("tag_counts")(lambda t: people.tag_counts(t.reviews))


@query("first_order_discount")
def _first_order(t: Tables) -> DataFrame:
    # Sign-ups without an order beside the customers.
    users = t.users.select(F.explode(F.array("user_id", F.col("user_id") + 10000000)).alias("user_id"))
    return people.first_order_discount(t.replace(users=users))


query("driver_list")(lambda t: people.driver_list(t))
query("row_totals")(lambda t: catalogue.row_totals(t))


@query("split_by_existence")
def _split(t: Tables) -> DataFrame:
    added, skipped = orders.reorder_split(some_gone(t))
    return added.select("*", F.lit("added").alias("half")).unionByName(
        skipped.select("*", F.lit("skipped").alias("half"))
    ).groupBy("half", "order_id").agg(F.sum("product_qty").alias("qty"))


@query("order_document")
def _order_document(t: Tables) -> DataFrame:
    line = lambda i: F.concat_ws(
        "/", i["itmname"], i["price"].cast("string"), i["qty"].cast("string"), i["total"].cast("string"), i["unit"])
    return orders.order_document(t).select(
        "order_id", "page_no", "order_no", "address", "customer.name", "customer.phone",
        "billdetails.item_total", "billdetails.handling_fee", "billdetails.delivery_fee",
        "billdetails.discount", "billdetails.total_amount", "billdetails.coupon_code", "paydetails.pay_mode",
        F.array_join(F.transform("itmdetails", line), "; ").alias("items"))


# --- purchases and invoices -----------------------------------------------------

query("purchase_list")(lambda t: purchases.purchase_list(t))
query("purchase_page")(lambda t: purchases.purchase_list(t, "ref-", dt.date(1997, 1, 5), None, 1, 15))
query("invoice_header")(lambda t: invoices.invoice_header(t))
query("invoice_text")(lambda t: invoices.invoice_text(t))


@query("purchase_document")
def _purchase_document(t: Tables) -> DataFrame:
    line = lambda i: F.concat_ws(
        "/", i["item_id"].cast("string"), i["unit_name"], i["quantity"].cast("string"), i["value"].cast("string"))
    return purchases.purchase_document(t, page_rows=100).select(
        "purchase_id", "page_no", "purchase_no", "purchase_date", "reference",
        F.array_join(F.transform("purchase_items", line), "; ").alias("items"))


@query("invoice_document")
def _invoice_document(t: Tables) -> DataFrame:
    line = lambda i: F.concat_ws(
        "/", i["position"].cast("string"), i["product_name"], i["product_qty"].cast("string"),
        i["product_amount"].cast("string"))
    return invoices.invoice_document(t, page_rows=4).select(
        "order_id", "page_no", "order_no", "total_amount", "created_at", "customer_name", "phone", "full_address",
        F.array_join(F.transform("items", line), "; ").alias("items"))


# --- catalogue --------------------------------------------------------------------

query("catalogue_list")(lambda t: catalogue.catalogue_list(t))
query("catalogue_page")(lambda t: catalogue.catalogue_list(t, "WIDGET", 2, 15))
query("catalogue_page_after")(lambda t: catalogue.catalogue_list(t, "WIDGET", size=15, after=(60,)))
query("category_items")(lambda t: catalogue.category_items(t, default_open_date=OPEN_DATE))
query("search_items")(lambda t: catalogue.search_items(t, "ring", OPEN_DATE))
query("popular_tags")(lambda t: catalogue.popular_tags(t))
query("global_search")(lambda t: catalogue.global_search(t, "m"))
query("item_prices")(lambda t: catalogue.item_prices(t))
query("super_deals")(lambda t: catalogue.super_deals(t))
query("deal_price")(lambda t: catalogue.deal_price(t, default_open_date=OPEN_DATE))
query("ordered_categories")(lambda t: catalogue.ordered_categories(t))
query("recommendations")(lambda t: catalogue.recommendations(t, default_open_date=OPEN_DATE))
query("home_feed")(lambda t: catalogue.home_feed(t, OPEN_DATE))
query("favourites_list")(lambda t: catalogue.favourites_list(t))
query("cart_list")(lambda t: catalogue.cart_list(t))
query("flash_sale_items")(lambda t: catalogue.flash_sale_items(t, None, dt.datetime(1998, 2, 1)))


@query("flash_sale_orders")
def _flash_sale_orders(t: Tables) -> DataFrame:
    # Times within the day for orders and sales.
    hours = lambda column: F.make_dt_interval(hours=(column % 24).cast("int"), mins=(column % 60).cast("int"))
    timed = t.orders.withColumn("created_at", F.col("created_at") + hours(F.col("order_id")))
    sales = t.flash_sales.withColumns({
        "from_datetime": F.col("from_datetime") + hours(F.col("flsh_trnid")),
        "to_datetime": F.col("to_datetime") + hours(F.col("flsh_trnid") * 7)})
    return catalogue.flash_sale_orders(t.replace(orders=timed, flash_sales=sales))


query("dedupe_any")(lambda t: t.products.join(t.images, "product_id").groupBy("product_id", "title").agg(
    F.min("image_url").alias("image")))


@star_query("missing_dimension_members")
def _missing(star: StarSchema) -> DataFrame:
    t, sheet = star.tables(), star.item_sheet()
    kinds = (("category", "categoriesname", t.categories, "categories_name"),
             ("unit", "unit", t.units, "unitshortcode"), ("title", "title", t.products, "title"))
    found = [catalogue.missing_members(sheet, c, m, k).select(F.lit(n).alias("kind"), "member") for n, c, m, k in kinds]
    return found[0].unionByName(found[1]).unionByName(found[2])


star_query("distinct_members")(lambda star: catalogue.distinct_members(star.item_sheet(), "categoriesname"))

# --- prices -------------------------------------------------------------------------


def carts(t: Tables) -> DataFrame:
    """Orders seen as carts, each with a coupon code entered in any case."""
    return t.orders.select(
        F.col("order_id").alias("cart_id"), "user_id",
        F.concat(F.lit("save"), (F.col("order_id") % 95).cast("string")).alias("coupon_code"),
        F.col("total_amount").alias("cart_total"))


COUPON_DAY = dt.date(2000, 6, 1)

query("apply_coupon")(lambda t: pricing.apply_coupon(t, carts(t), COUPON_DAY))


@query("checkout_price")
def _checkout(t: Tables) -> DataFrame:
    # Every fourth cart is a guest's, who has never ordered.
    user = F.when(F.col("cart_id") % 4 == 0, F.col("user_id") + 10000000).otherwise(F.col("user_id"))
    return pricing.checkout_price(t, carts(t).withColumn("user_id", user), COUPON_DAY)


query("coupon_list_with_usage")(lambda t: pricing.coupon_list_with_usage(t, 20))
query("coupon_uses")(lambda t: pricing.coupon_uses(t))
query("cart_bill")(lambda t: pricing.cart_bill(t, 5, 25))
star_query("delivery_slots")(lambda star: pricing.delivery_slots(
    star.raw("events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"))))


@query("payment_signature_audit")
def _signatures(t: Tables) -> DataFrame:
    key, refs = F.col("order_id"), ("order_ref", "payment_ref")
    rows = t.payments.select(
        "order_id", F.concat(F.lit("order_"), key.cast("string")).alias(refs[0]),
        F.concat(F.lit("pay_"), F.col("method"), pad_number(key, 8)).alias(refs[1]))
    # A third is signed with the key, a third with another one, the rest not at all.
    message = F.concat_ws("|", *refs)
    rows = rows.withColumn("signature", F.when(key % 3 == 1, hmac_sha256(message, "test-secret"))
                           .when(key % 3 == 2, hmac_sha256(message, "other-secret")))
    return pricing.payment_signature_audit(rows, "test-secret").select("order_id", "expected", "is_valid")


def codes(star: StarSchema) -> tuple[DataFrame, DataFrame]:
    """Codes issued and entered; some have no code and some attempts no user."""
    events = star.raw("events").select(
        F.when(F.col("event_id") % 40 != 0, F.col("user_id")).alias("user_id"), F.col("ts").alias("at"),
        F.col("event_id").alias("seq"), F.nullif(F.floor("value").cast("long") % 4, F.lit(3)).alias("code"), "event_type")
    columns = ("user_id", "at", "seq", "code")
    return (events.where("event_type = 'signup'").select(*columns), events.where("event_type = 'purchase'").select(*columns))


star_query("otp_match")(lambda star: pricing.otp_match(*codes(star), dt.timedelta(days=2)))
star_query("otp_match_delivery")(lambda star: pricing.otp_match(*codes(star), None))


@query("address_components")
def _components(t: Tables) -> DataFrame:
    key = F.col("address_id")

    def part(when, kind: str, name) -> Column:
        return F.when(when, F.struct(F.array(F.lit(kind), F.lit("political")).alias("types"), name.alias("long_name")))

    parts = F.array_compact(F.array(
        part(key % 2 == 0, "route", F.concat(F.lit("Road "), key.cast("string"))),
        part(key % 3 == 0, "sublocality", F.concat(F.lit("Ward "), key.cast("string"))),
        part(key % 5 == 0, "sublocality_level_1", F.concat(F.lit("Block "), key.cast("string"))),
        part(key % 7 != 0, "locality", F.coalesce("city", F.lit(""))),
        part(key % 4 != 0, "administrative_area_level_2", F.col("name")),
        part(key % 6 != 0, "postal_code", F.col("phone")),
    ))
    documents = t.addresses.select(key.alias("document_id"), F.to_json(parts).alias("components"))
    return pricing.address_components(documents)

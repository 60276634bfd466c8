"""Loading, change application and streams as registered queries.

The batches of changes are relabelled events and parts, so they grow with the
tables they are applied to.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators import changes, ingest, stock
from storelens.operators.numbering import document_number
from storelens.operators.orders import line_documents
from storelens.plans.registered import OPEN_DATE, QUERIES, plain, star_query
from storelens.plans.session import scratch_folder
from storelens.sources.binding import SCHEMAS, StarSchema
from storelens.sources.readers import bulk_item_scan, nested_order_scan
from storelens.sources.sinks import fanout_of, read_fanout, tagged_fanout, write_fanout
from storelens.sources.tables import Tables
from storelens.streaming import carts, feeds

# Lines to one submitted order document.
DOCUMENT_ROWS = 1000


def event_no() -> Column:
    return F.col("event_id")


def money(column: Column) -> Column:
    return column.cast("decimal(10,2)")


# --- loading ----------------------------------------------------------------


@star_query("bulk_item_scan")
def _sheet(star: StarSchema) -> DataFrame:
    """The item sheet saved as CSV files and scanned from there."""
    path = scratch_folder(star.spark, "item-sheet")
    star.item_sheet().drop("trnid").select(
        "title", "categoriesname", "description", "price", "mrp", "quantity", "unit"
    ).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return bulk_item_scan(star.spark, path)


for _part in ("categories", "units", "products"):
    star_query(f"bulk_item_load_{_part}")(
        lambda star, part=_part: ingest.bulk_item_load(star.tables(), star.item_sheet())[part])


def catalogue_documents(star: StarSchema) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    picture = lambda k: F.concat(F.lit("doc/"), key.cast("string"), F.lit(f"-{k}.png"))
    return star.raw("part").select(
        key.alias("seq"), F.when(key % 6 != 0, F.col("p_brand")).otherwise("").alias("category_name"),
        F.when(key % 11 == 0, "0").otherwise(F.col("p_name")).alias("title"), F.col("p_type").alias("description"),
        money(F.col("p_retailprice")).alias("price"), money(F.col("p_retailprice")).alias("mrp"),
        (size % 5).alias("quantity"), F.when(key % 7 != 0, F.lit("t.png")).alias("thumbnail"),
        F.when(size % 2 == 0, F.array(picture(1), picture(2))).alias("images"))


for _part in ("categories", "products", "images"):
    star_query(f"category_product_load_{_part}")(
        lambda star, part=_part: ingest.category_product_load(star.tables(), catalogue_documents(star))[part])


def order_documents(t: Tables) -> DataFrame:
    """Orders as submitted JSON; a long order is several documents."""
    names = ("product_id", "product_name", "product_unit", "product_qty", "product_rate", "product_amount")
    lines = t.order_items.select("order_id", "line_no", *names)
    header = t.orders.withColumns({
        "payment_method": F.when(F.col("order_id") % 3 == 0, "COD").otherwise("UPI"),
        "transaction_id": F.when(F.col("order_id") % 3 == 0, "").otherwise(F.concat(F.lit("tx"), "order_id")),
        "delivery_start": F.date_format("delivery_start", "yyyy-MM-dd HH:mm:ss"),
    })
    document = F.struct(
        "order_id", F.col("page_no").alias("part_no"), "user_id", "address_delivery", "total_amount", "order_status", "payment_status",
        "payment_method", "delivery_id", "delivery_start", "coupon_code", "transaction_id", "items_details")
    item = lambda row, _: F.struct(*[row[name].alias(name) for name in names])
    return line_documents(header, lines, item, DOCUMENT_ROWS, "items_details").select(
        F.to_json(document).alias("document"))


@star_query("nested_order_scan")
def _nested(star: StarSchema) -> DataFrame:
    _, lines = nested_order_scan(order_documents(star.tables()))
    item_no = F.col("item_no") + F.coalesce("part_no", F.lit(0)) * DOCUMENT_ROWS
    return lines.select(
        "order_id", "user_id", "total_amount", item_no.alias("item_no"), "product_id", "product_qty", "product_amount")


for _part in ("orders", "order_items", "ledger", "payments", "tracking", "coupon_usage"):
    @star_query(f"order_fanout_{_part}")
    def _fanout(star: StarSchema, part=_part) -> DataFrame:
        t = star.tables()
        return fanout_of(part, order_documents(t), t.coupons, dt.date(2001, 8, 1))


@star_query("order_fanout_written")
def _fanout_written(star: StarSchema) -> DataFrame:
    """All six tables written by one job and read back: rows and sum of order ids of each."""
    t = star.tables()
    tagged = tagged_fanout(order_documents(t), t.coupons, dt.date(2001, 8, 1))
    folder = scratch_folder(star.spark, "order-fanout")
    write_fanout(tagged, folder, 0)
    order = F.coalesce("orders.order_id", "order_items.order_id", "ledger.orderid", "payments.order_id", "tracking.order_id",
                       "coupon_usage.order_id")
    return read_fanout(star.spark, folder, tagged.schema).groupBy("output").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(order).alias("order_ids"))


def purchase_documents(star: StarSchema) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")

    def item(shift: int) -> Column:
        return F.struct(
            (key + shift).alias("item_id"), F.col("p_name").alias("item_name"), (size % 5).alias("unit_id"),
            (size + shift).alias("quantity"), money(F.col("p_retailprice")).alias("rate"),
            (money(F.col("p_retailprice")) * (size + shift)).alias("value"),
            F.lit(1).alias("instore_id"), F.lit(0).alias("outstore_id"))

    day = F.date_add(F.lit("2000-01-01").cast("date"), size)
    items = F.when(size % 9 != 0, F.array(item(0), item(1)))
    document = F.struct(F.struct(day.alias("purchase_date")).alias("purchase_header"), items.alias("purchase_items"))
    return star.raw("part").select(
        key.alias("seq"), (size % 4).alias("register_id"), F.to_json(document).alias("document"))


star_query("purchase_post_headers")(lambda star: ingest.purchase_post(purchase_documents(star), last=9990)[0])
star_query("purchase_post_lines")(lambda star: ingest.purchase_post(purchase_documents(star))[1])


def flash_documents(star: StarSchema) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    opens = F.date_add(F.lit("2000-01-01").cast("date"), size).cast("timestamp_ntz")
    line = lambda shift: F.struct((key + shift).alias("product_id"), money(F.col("p_retailprice") - shift).alias("product_rate"))
    document = F.struct(
        opens.alias("from_datetime"), (opens + F.expr("interval 3 days")).alias("to_datetime"),
        F.array(line(0), line(1), line(2)).alias("items_details"))
    return star.raw("part").select(
        key.alias("seq"), (size % 3).alias("register_id"),
        F.to_json(document, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("document"))


star_query("flash_sale_post_headers")(lambda star: ingest.flash_sale_post(flash_documents(star))[0])
star_query("flash_sale_post_lines")(lambda star: ingest.flash_sale_post(flash_documents(star))[1])


@star_query("document_number")
def _document_number(star: StarSchema) -> DataFrame:
    t = star.tables()
    rows = t.orders.select("order_id", "user_id").join(t.users.select("user_id", "register_id"), "user_id")
    return document_number(rows, "order_id", "ORD", 9900, 4, by=["register_id"]).drop("user_id")


# --- catalogue changes ----------------------------------------------------------


@star_query("category_upsert")
def _category_upsert(star: StarSchema) -> DataFrame:
    key, t = F.col("p_partkey"), star.tables()
    rows = t.products.join(star.raw("part").select(key.alias("product_id"), "p_brand", "p_size"), "product_id")
    key = F.col("product_id")
    batch = rows.select(
        key.alias("seq"), (key % 2).alias("mode"),
        F.when(key % 2 == 0, key + 100000).otherwise(F.col("categories_id")).alias("categories_id"),
        F.when(key % 5 == 0, F.col("category")).otherwise(F.col("p_brand")).alias("categories_name"),
        (F.col("p_size") % 2).alias("cat_sts"))
    return changes.category_upsert(t.categories, batch)


def item_saves(star: StarSchema) -> DataFrame:
    value = F.floor("value")
    insert = event_no() % 3 == 0
    return star.raw("events").select(
        event_no().alias("seq"), F.when(~insert, event_no() % 2500).alias("product_id"), (event_no() + 10000000).alias("new_id"),
        F.when(event_no() % 9 == 0, F.lit(" SMALL Ring")).when(insert, F.concat(F.lit(" New Item "), (event_no() % 400).cast("string")))
        .otherwise(F.concat(F.lit("Changed "), event_no().cast("string"))).alias("name"),
        (event_no() % 9).cast("int").alias("category"), F.when(event_no() % 2 == 0, F.col("event_type")).alias("description"),
        money(value).alias("base_price"), F.when(event_no() % 5 != 0, money(value + 1)).alias("mrp"),
        (event_no() % 4).cast("int").alias("unit"), F.when(event_no() % 7 != 0, (event_no() % 30).cast("int")).alias("stock_qty"),
        F.when(event_no() % 6 != 0, (event_no() % 20).cast("int")).alias("open_qty"), F.lit(None).cast("date").alias("open_date"),
        F.when(event_no() % 10 == 0, 0).alias("sts"),
        F.when(event_no() % 4 == 0, F.concat(F.lit("new/"), event_no().cast("string"))).alias("image"))


for _no, _name in enumerate(("item_upsert", "item_upsert_images", "item_upsert_refused")):
    @star_query(_name)
    def _item_upsert(star: StarSchema, no=_no) -> DataFrame:
        t = star.tables()
        return changes.item_upsert(t.products, t.images, item_saves(star))[no]


@star_query("discount_update")
def _discount_update(star: StarSchema) -> DataFrame:
    batch = star.raw("events").select(
        event_no().alias("seq"), (event_no() % 2500).alias("product_id"), (event_no() % 4).cast("int").alias("mode"),
        (event_no() % 60).cast("decimal(5,2)").alias("percent"))
    products = star.tables().products.select("product_id", "title", "discount_per", "discount_sts")
    return changes.discount_update(products, batch)


# --- purchases and orders ----------------------------------------------------------


def _by_purchase(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("purchase_id", "itmid").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("stockqty").alias("qty"),
        F.sum("itmcandel").alias("item_flags"), F.sum("canordersts").alias("order_flags"),
        F.max("purchase_date").alias("last_date"))


def purchase_replacement(star: StarSchema) -> tuple[DataFrame, DataFrame]:
    t, key = star.tables(), F.col("s_suppkey")
    headers = star.raw("supplier").where(key % 3 == 0).select(
        key.alias("seq"), key.alias("purchaseid"),
        F.when(key % 2 == 0, F.col("s_nationkey")).otherwise(-1).alias("storeid"),
        F.lit("2002-02-02").cast("date").alias("purchasedate"))
    part = F.col("product_id")
    lines = t.products.select(
        (part % 120).alias("purchase_id"), F.lit(0).cast("long").alias("orderid"), part.alias("itmid"),
        F.lit(1).alias("line_no"), F.lit(None).cast("date").alias("purchase_date"), F.lit(1).alias("instoreid"),
        F.lit(0).alias("outstoreid"), F.col("unit").alias("unitid"), F.lit(9).alias("stockqty"),
        F.col("price").cast("decimal(12,2)").alias("value"), F.lit(None).cast("int").alias("itmcandel"),
        F.lit(None).cast("int").alias("canordersts"))
    return changes.purchase_replace(t.purchases, t.ledger, headers, lines)


star_query("purchase_replace_headers")(
    lambda star: purchase_replacement(star)[0].select("purchaseid", "purchasedate", "storeid"))
star_query("purchase_replace_lines")(lambda star: _by_purchase(purchase_replacement(star)[1]))


def item_cancels(star: StarSchema) -> DataFrame:
    return star.raw("events").select((event_no() % 100).alias("purchase_id"), (event_no() * 7 % 2000).alias("itmid"))


star_query("purchase_item_cancel")(
    lambda star: _by_purchase(changes.purchase_item_cancel(star.tables().ledger, item_cancels(star))[0]))
star_query("purchase_item_cancel_refused")(
    lambda star: changes.purchase_item_cancel(star.tables().ledger, item_cancels(star))[1])


def purchase_cancels(star: StarSchema) -> tuple[DataFrame, DataFrame]:
    t, key = star.tables(), F.col("s_suppkey")
    batch = star.raw("supplier").where(key % 2 == 0).select(
        key.alias("purchaseid"), F.when(key % 4 == 0, F.col("s_nationkey")).otherwise(-1).alias("storeid"))
    return changes.purchase_cancel(t.purchases, t.ledger, batch)


star_query("purchase_cancel_headers")(lambda star: purchase_cancels(star)[0].select("purchaseid", "cansts"))
star_query("purchase_cancel_lines")(lambda star: _by_purchase(purchase_cancels(star)[1]))


def order_cancels(star: StarSchema) -> tuple[DataFrame, DataFrame]:
    t = star.tables()
    return changes.order_cancel(t.orders, t.ledger, star.raw("events").select((event_no() * 3).alias("order_id")))


star_query("order_cancel_orders")(lambda star: order_cancels(star)[0].select("order_id", "order_status"))
star_query("order_cancel_ledger")(lambda star: _by_purchase(order_cancels(star)[1]))


def delivery_events(star: StarSchema) -> DataFrame:
    return star.raw("events").where(F.col("event_type").isin("view", "click")).select(
        event_no().alias("seq"), (event_no() % 900).alias("order_id"),
        F.when(F.col("event_type") == "view", "out_for_delivery").otherwise("delivered").alias("state"),
        F.when(event_no() % 7 != 0, event_no() % 2 == 0).alias("by_partner"))


for _no, _part in enumerate(("orders", "payments", "tracking")):
    @star_query(f"order_state_apply_{_part}")
    def _state(star: StarSchema, no=_no) -> DataFrame:
        t = star.tables()
        orders = t.orders.select("order_id", "order_status", "payment_status")
        payments = t.payments.select("order_id", "method", "status")
        return changes.order_state_apply(orders, payments, delivery_events(star))[no]


@star_query("coupon_apply_changes")
def _coupon_changes(star: StarSchema) -> DataFrame:
    kind = F.col("event_type")
    batch = star.raw("events").where(kind.isin("view", "click", "error")).select(
        event_no().alias("seq"), F.when(kind == "error", "delete").otherwise("create").alias("op"),
        # Some deletions are of coupons that the batch creates just before or after.
        F.when(kind != "error", event_no() + 1000000).when(event_no() % 2 == 0, event_no() + 999999)
        .when(event_no() % 5 == 0, event_no() + 1000001).otherwise(event_no() % 150).alias("coupon_id"),
        F.concat(F.when(event_no() % 2 == 0, "gift").otherwise("save"), (event_no() % 300).cast("string")).alias("coupon_code"),
        F.when(event_no() % 3 == 0, "FLAT").otherwise("PERCENT").alias("discount_type"), money(event_no() % 50 + 1).alias("discount_value"),
        F.when(event_no() % 5 != 0, money(event_no() % 700)).alias("min_order_value"), money(event_no() % 4 * 100).alias("max_discount"),
        F.when(event_no() % 6 != 0, F.lit("2003-03-03").cast("date")).alias("expiry_date"))
    return changes.coupon_apply_changes(star.tables().coupons, batch)


@star_query("coupon_usage_append")
def _usage(star: StarSchema) -> DataFrame:
    t = star.tables()
    batch = t.orders.select("order_id", "user_id", F.concat(F.lit("SAVE"), (F.col("order_id") % 7 * 10).cast("string"))
                            .alias("coupon_code"))
    return changes.coupon_usage_append(t.coupon_usage, t.coupons, batch)


# --- people and carts ------------------------------------------------------------


def cart_actions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = (F.when(kind == "view", "add").when(kind == "click", "set").when(kind == "error", "remove")
          .when(kind == "purchase", "reorder").otherwise("clear"))
    return events.select(
        event_no().alias("seq"), "user_id", F.when(kind != "signup", event_no() % 5).alias("product_id"), op.alias("op"),
        F.when(event_no() % 4 != 0, F.floor("value").cast("long") + 1).when(kind == "purchase", F.lit(2).cast("long")).alias("qty"))


def carts_before(star: StarSchema) -> DataFrame:
    key = F.col("c_custkey")
    return star.raw("customer").select(
        key.alias("user_id"), (key % 5).alias("product_id"), (key % 9 + 1).alias("quantity"),
        F.when(key % 3 == 0, "removed").otherwise("active").alias("status"))


star_query("cart_merge")(lambda star: changes.cart_merge(carts_before(star), cart_actions(star.raw("events"))))


@star_query("favourite_toggle")
def _toggle(star: StarSchema) -> DataFrame:
    batch = star.raw("events").where(F.col("event_type").isin("click", "view")).select("user_id", (event_no() % 200).alias("product_id"))
    return changes.favourite_toggle(star.tables().favourites, batch)


@star_query("address_apply_changes")
def _address_changes(star: StarSchema) -> DataFrame:
    kind, insert = F.col("event_type"), F.col("event_type") == "signup"
    given = F.array_compact(F.array(F.when(event_no() % 2 == 0, "name"), F.when(event_no() % 3 == 0, "full_address")))
    first = star.raw("events").where(kind != "purchase").select(
        event_no().alias("seq"), F.when(insert, "insert").when(kind == "error", "delete").otherwise("update").alias("op"),
        F.when(insert, event_no() + 10000000).otherwise(event_no()).alias("address_id"),
        F.when((event_no() % 4 == 0) & ~insert, 99999).otherwise(F.col("user_id")).alias("user_id"), given.alias("given"),
        F.when(event_no() % 8 != 6, F.concat(F.lit("Name "), event_no().cast("string"))).alias("name"),
        F.concat(F.lit("Street "), event_no().cast("string")).alias("full_address"), F.col("ts").alias("created_at"))
    second = first.where((F.col("op") == "update") & (F.col("seq") % 5 == 1)).withColumns({
        "seq": F.col("seq") + 20000000, "given": F.array(F.lit("full_address")), "full_address": F.lit("Second")})
    # Changes to addresses that the batch inserts: after that, and before it.
    made = first.where(F.col("op") == "insert")
    third = made.where(F.col("seq") % 3 == 0).withColumns({
        "op": F.lit("update"), "seq": F.col("seq") + 30000000, "given": F.array(F.lit("full_address")), "full_address": F.lit("Third")})
    fourth = made.where(F.col("seq") % 5 == 0).withColumns({
        "op": F.lit("delete"), "seq": F.when(F.col("seq") % 2 == 0, F.col("seq") + 40000000).otherwise(-F.col("seq"))})
    current = star.tables().addresses.select("address_id", "user_id", "name", "full_address", "created_at")
    batch = first.unionByName(second).unionByName(third).unionByName(fourth)
    return changes.address_apply_changes(current, batch, ["name", "full_address"])


@star_query("default_address_set")
def _default(star: StarSchema) -> DataFrame:
    batch = star.raw("events").where(event_no() % 3 == 0).select(
        event_no().alias("seq"), F.when(event_no() % 4 == 0, 99999).otherwise(F.col("user_id")).alias("user_id"), event_no().alias("address_id"))
    current = star.tables().addresses.select("address_id", "user_id", "is_default")
    return changes.default_address_set(current, batch)


@star_query("profile_update")
def _profile(star: StarSchema) -> DataFrame:
    t = star.tables()
    batch = t.users.select(F.col("user_id").alias("seq"), "user_id", "name", "phone")
    return changes.profile_update(t.addresses.select("address_id", "user_id", "name", "phone", "is_default"), batch)


@star_query("review_insert_once")
def _review(star: StarSchema) -> DataFrame:
    batch = star.raw("events").select(event_no().alias("seq"), (event_no() % 1700).alias("user_id"), (event_no() % 5 + 1).cast("int").alias("rating"))
    return changes.review_insert_once(star.tables().reviews, batch, ["rating"])


@star_query("partner_apply_changes")
def _partner(star: StarSchema) -> DataFrame:
    key = F.col("c_custkey")
    op = F.when(key % 3 == 0, "create").when(key % 3 == 1, "update").otherwise("delete")
    batch = star.raw("customer").select(
        key.alias("seq"), op.alias("op"),
        # Some changes are to partners that the batch creates before or after.
        F.when(key % 3 == 0, key + 100000).when((key % 3 == 1) & (key % 4 == 1), key + 99999)
        .when((key % 3 == 2) & (key % 8 == 2), key + 99998).when((key % 3 == 2) & (key % 8 == 5), key + 100001)
        .otherwise(key % 130).alias("driver_id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lit("7"), F.lpad((key % 400).cast("string"), 9, "0")).alias("mobile"),
        (key % 2).cast("int").alias("status"))
    return changes.partner_apply_changes(star.tables().partners, batch)


@star_query("walkin_customer_append")
def _walkin(star: StarSchema) -> DataFrame:
    key = F.col("s_suppkey")
    batch = star.raw("supplier").select(
        (key + 1000000).alias("user_id"), F.col("s_name").alias("name"), key.cast("string").alias("phone"),
        F.concat(key.cast("string"), F.lit("@example.com")).alias("email"))
    return changes.walkin_customer_append(star.tables().users, batch)


@star_query("touch_updated_at")
def _touch(star: StarSchema) -> DataFrame:
    before = star.tables().cart.withColumnRenamed("created_at", "updated_at")
    after = before.withColumn("quantity", F.when(F.col("cart_id") % 3 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")))
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    return changes.touch_updated_at(before, after, ["cart_id"], ["quantity", "status"], now).select(
        "cart_id", "quantity", "status", "updated_at")


# --- streams -----------------------------------------------------------------------


class StreamedSchema(StarSchema):
    """The star schema with one of its files read as a stream."""

    def __init__(self, spark, folder: str, streamed: str):
        super().__init__(spark, folder)
        self.streamed = streamed

    def raw(self, name: str) -> DataFrame:
        if name == self.streamed:
            return feeds.file_stream(self.spark, self.folder, f"{name}.parquet", SCHEMAS[name])
        return super().raw(name)


def stream_query(name: str, streamed: str):
    """Register a stream that runs over the whole file and is then read back.

    The function takes the streamed schema and a fresh target folder.
    """
    def register(run):
        def build(spark, folder: str) -> DataFrame:
            target = scratch_folder(spark, name)
            return plain(run(StreamedSchema(spark, folder, streamed), target))
        QUERIES[name] = build
        return run
    return register


@stream_query("new_order_feed", "orders")
def _feed(star: StreamedSchema, target: str) -> DataFrame:
    stores = star.users().select("user_id", "register_id")
    accepted = feeds.new_order_feed(star.orders().join(stores, "user_id"))
    feeds.write_batches(accepted, target).awaitTermination()
    return feeds.read_batches(star.spark, target, accepted.schema)


def _folded(rows: DataFrame, target: str, fold: feeds.Fold) -> DataFrame:
    feeds.fold_stream(rows, target, fold).awaitTermination()
    return feeds.read_folded(rows.sparkSession, target, fold, rows.schema)


@stream_query("stream_daily_revenue", "orders")
def _revenue(star: StreamedSchema, target: str) -> DataFrame:
    return _folded(feeds.daily_revenue_rows(star.orders()), target, feeds.daily_revenue)


@stream_query("stream_stock_level", "lineitem")
def _stock(star: StreamedSchema, target: str) -> DataFrame:
    daily = _folded(feeds.stock_movement_rows(star.ledger()), target, feeds.stock_movements)
    t = Tables(products=star.products())
    moved = stock.since_opening(t, daily, OPEN_DATE, "moved")
    return t.products.select("product_id", "openbalqty").join(moved, "product_id", "left").select(
        "product_id", (F.coalesce("openbalqty", F.lit(0)) + F.coalesce("moved", F.lit(0))).alias("stock"))


@stream_query("stream_order_status", "events")
def _status(star: StreamedSchema, target: str) -> DataFrame:
    states = _folded(feeds.order_status_rows(star.tracking()), target, feeds.order_statuses)
    return states.select("order_id", "last.status", F.col("last.created_at").alias("status_at"))


@stream_query("stream_cart_state", "events")
def _cart(star: StreamedSchema, target: str) -> DataFrame:
    actions = cart_actions(star.raw("events"))
    carts.cart_stream(actions, target).awaitTermination()
    return carts.read_cart(star.spark, target)

"""Batches of submitted changes applied to a table, giving the table as it is afterwards.

A batch has one row per change with a growing ``seq``. A change is checked
against the table as it was before the batch; of several changes to one key
the last one counts unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.keyed import latest, spread_join, stretch


def merge(current: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str],
          upsert: bool = True) -> DataFrame:
    """Current rows with the last change of each key applied.

    ``changes`` has the keys, ``columns``, ``seq`` and ``op`` (``put`` or
    ``delete``). Without ``upsert`` a change to an unknown key is dropped.
    """
    last = latest(changes, keys, ["seq"], [F.col("op").alias("_op"), *[F.col(c).alias(f"_{c}") for c in columns]])
    joined = current.withColumn("_here", F.lit(True)).join(last, list(keys), "full" if upsert else "left")
    kept = joined.where(F.col("_op").isNull() | (F.col("_op") != "delete"))
    changed = F.col("_op").isNotNull()
    return kept.select(
        *[F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
          for c in current.columns]
    )


def first_per(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first row of each key by ``seq``."""
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct("seq", *columns), "seq").alias("_row"))
        .select(*keys, "_row.*")
    )


def category_upsert(categories: DataFrame, changes: DataFrame) -> DataFrame:
    """Categories after inserts (mode 0) and renames (mode 1).

    ``changes``: seq, mode, categories_id (the new key for an insert),
    categories_name, cat_sts. A name held by another category is refused; of
    several changes that ask for one name the first gets it.
    """
    names = categories.select("categories_name", F.col("categories_id").alias("_holder"))
    known = categories.select("categories_id", F.lit(True).alias("_known"))
    asked = changes.join(names, "categories_name", "left").join(known, "categories_id", "left")
    insert = (F.col("mode") == 0) & F.col("_known").isNull() & F.col("_holder").isNull()
    own_name = F.col("_holder").isNull() | (F.col("_holder") == F.col("categories_id"))
    rename = (F.col("mode") == 1) & F.col("_known") & own_name
    granted = first_per(asked.where(insert | rename), ["categories_name"], ["mode", "categories_id", "cat_sts"])
    applicable = granted.withColumn("op", F.lit("put"))
    return merge(categories, applicable, ["categories_id"], ["categories_name", "cat_sts"])


def item_upsert(products: DataFrame, images: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products and images after item saves, and the refused saves.

    ``changes``: seq, product_id (NULL to insert), new_id, name, category,
    description, base_price, mrp, unit, stock_qty, open_qty, open_date, sts, image.
    An insert is refused if the title exists in any case; an update of an
    unknown item is refused; a new image replaces all images of the item.
    """
    columns = {
        "categories_id": F.coalesce("category", F.lit(0)),
        "title": F.trim("name"),
        "description": F.coalesce("description", F.lit("")),
        "price": F.coalesce("base_price", F.lit(0)),
        "mrp": F.coalesce("mrp", F.lit(0)),
        "unit": F.col("unit"),
        "lowstqty": F.coalesce("stock_qty", F.lit(0)),
        "itmsts": F.coalesce("sts", F.lit(1)),
        "openbalqty": F.coalesce("open_qty", F.lit(0)),
        "openbaldate": F.col("open_date"),
    }
    saves = changes.select("seq", "product_id", "new_id", "image", *[c.alias(n) for n, c in columns.items()])
    insert = F.col("product_id").isNull() | (F.col("product_id") == 0)

    titles = products.select(F.lower("title").alias("_title")).distinct()
    asked = saves.where(insert).withColumn("_title", F.lower("title"))
    first = first_per(asked, ["_title"], [c for c in asked.columns if c not in ("seq", "_title")])
    winners = first.join(titles, "_title", "left_anti").drop("_title")
    inserts = winners.withColumn("product_id", F.col("new_id"))

    known = products.select("product_id").withColumn("_known", F.lit(True))
    updates_all = saves.where(~insert).join(known, "product_id", "left")
    updates = updates_all.where("_known").drop("_known")
    refused = (
        saves.where(insert).join(winners.select("seq"), "seq", "left_anti")
        .select("seq", F.lit("Item name already exists").alias("reason"))
        .unionByName(updates_all.where("_known is null").select("seq", F.lit("Product not found").alias("reason")))
    )

    accepted = inserts.unionByName(updates).drop("new_id")
    kept_columns = ["product_id", *columns]
    puts = accepted.withColumn("op", F.lit("put"))
    result = merge(products.select(*kept_columns), puts, ["product_id"], list(columns))

    pictured = accepted.where("image is not null and image <> ''")
    last_image = latest(pictured, ["product_id"], ["seq"], [F.col("image").alias("image_url")])
    new_images = (
        images.select("product_id", "image_url").join(last_image.select("product_id"), "product_id", "left_anti")
        .unionByName(last_image)
    )
    return result, new_images, refused


def discount_update(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Products after offers are set (mode 1) or cleared (mode 2).

    ``changes``: seq, product_id, mode, percent.
    """
    on = F.col("mode") == 1
    sets = changes.where(F.col("mode").isin(1, 2)).select(
        "seq", "product_id", F.lit("put").alias("op"),
        F.when(on, F.col("percent")).otherwise(0).cast("decimal(5,2)").alias("discount_per"),
        F.when(on, 1).otherwise(0).alias("discount_sts"),
    )
    return merge(products, sets, ["product_id"], ["discount_per", "discount_sts"], upsert=False)


def purchase_replace(purchases: DataFrame, ledger: DataFrame, headers: DataFrame,
                     lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purchases with new dates, and the ledger with all lines of those purchases replaced.

    ``headers``: seq, purchaseid, storeid, purchasedate; ``lines``: the new
    ledger lines with purchase_id. Only purchases of the right store change.
    New lines get the default cancel flags.
    """
    own = headers.join(purchases.select("purchaseid", "storeid"), ["purchaseid", "storeid"], "left_semi")
    last = latest(own, ["purchaseid"], ["seq"], [F.col("purchasedate").alias("_date")])
    moved = purchases.join(last, "purchaseid", "left").withColumn(
        "purchasedate", F.coalesce("_date", "purchasedate")
    ).drop("_date")
    changed = last.select(F.col("purchaseid").alias("purchase_id"), "_date")
    marks = changed.select("purchase_id", F.lit(True).alias("_changed"))
    kept = spread_join(ledger, marks, ["purchase_id"], ["orderid", "itmid"]).where("_changed is null").drop("_changed")
    fresh = (
        spread_join(lines, changed, ["purchase_id"], ["itmid"], "inner")
        .withColumns({"purchase_date": F.col("_date"), "itmcandel": F.lit(0), "canordersts": F.lit(0)})
        .select(*ledger.columns)
    )
    return moved, kept.select(*ledger.columns).unionByName(fresh)


def purchase_item_cancel(ledger: DataFrame, cancels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger with the lines of (purchase, item) pairs soft-deleted, and the refused pairs.

    A pair without an active line is refused.
    """
    keys = ["purchase_id", "itmid"]
    active = ledger.where(F.col("itmcandel") == 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("_active"))
    wanted = cancels.select(*keys).distinct()
    granted = wanted.join(active, keys, "left_semi").withColumn("_cancel", F.lit(True))
    result = spread_join(ledger, granted, keys, ["orderid"]).withColumn(
        "itmcandel", F.when(F.col("_cancel"), 1).otherwise(F.col("itmcandel"))
    ).drop("_cancel")
    return result.select(*ledger.columns), wanted.join(active, keys, "left_anti")


def purchase_cancel(purchases: DataFrame, ledger: DataFrame, cancels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purchases and ledger after whole purchases are cancelled.

    ``cancels``: purchaseid, storeid. Needs the purchase's own store and a
    purchase that is not cancelled yet; only active lines are soft-deleted.
    """
    open_ones = purchases.where(F.col("cansts") == 0).select("purchaseid", "storeid")
    granted = (
        cancels.select("purchaseid", "storeid").distinct().join(open_ones, ["purchaseid", "storeid"], "left_semi")
        .select("purchaseid", F.lit(True).alias("_cancel"))
    )
    headers = purchases.join(granted, "purchaseid", "left").withColumn(
        "cansts", F.when(F.col("_cancel"), 1).otherwise(F.col("cansts"))
    ).drop("_cancel")
    hit = F.col("_cancel") & (F.col("itmcandel") == 0)
    marks = granted.withColumnRenamed("purchaseid", "purchase_id")
    lines = spread_join(ledger, marks, ["purchase_id"], ["orderid", "itmid"]).withColumn(
        "itmcandel", F.when(hit, 1).otherwise(F.col("itmcandel"))
    ).drop("_cancel")
    return headers.select(*purchases.columns), lines.select(*ledger.columns)


def order_cancel(orders: DataFrame, ledger: DataFrame, cancels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders set to cancelled, and their ledger rows marked."""
    keys = cancels.select("order_id").distinct().withColumn("_cancel", F.lit(True))
    after = orders.join(keys, "order_id", "left").withColumn(
        "order_status", F.when(F.col("_cancel"), "cancelled").otherwise(F.col("order_status"))
    )
    lines = spread_join(ledger, keys.withColumnRenamed("order_id", "orderid"), ["orderid"], ["itmid"]).withColumn(
        "canordersts", F.when(F.col("_cancel"), 1).otherwise(F.col("canordersts"))
    )
    return after.select(*orders.columns), lines.select(*ledger.columns)


def order_state_apply(orders: DataFrame, payments: DataFrame,
                      events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, payments and new tracking rows after delivery events.

    ``events``: seq, order_id, state (``out_for_delivery`` or ``delivered``),
    by_partner. Events count one after the other: a delivery that a partner
    reports always does; it also completes the payment (and a COD payment row)
    and leaves no tracking row. Any other delivery counts only if the order is
    out for delivery by then. Events of unknown orders are ignored.
    """
    known = orders.select("order_id", (F.col("order_status") == "out_for_delivery").alias("_was_out"))
    rows = spread_join(events, known, ["order_id"], ["seq"], "inner").withColumns({
        "_partner": F.coalesce("by_partner", F.lit(False)) & (F.col("state") == "delivered"), "_stretch": stretch("seq")})
    # The state before an event: after a delivery, counted or not, an order is not out. It is looked up within a
    # stretch of numbers, and across stretches through one row each.
    within = W.partitionBy("order_id", "_stretch").orderBy("seq")
    ends = rows.groupBy("order_id", "_stretch").agg(F.max_by("state", "seq").alias("_end"))
    carried = ends.select("order_id", "_stretch", F.lag("_end").over(W.partitionBy("order_id").orderBy("_stretch")).alias("_carried"))
    before = F.coalesce(F.col("_before"), F.col("_carried"))
    out = F.coalesce(before == "out_for_delivery", F.col("_was_out"), F.lit(False))
    counted = rows.withColumn("_before", F.lag("state").over(within)).join(carried, ["order_id", "_stretch"]).where(
        (F.col("state") != "delivered") | F.col("_partner") | out)
    last = latest(counted, ["order_id"], ["seq"], [F.col("state").alias("_state")])
    paid = counted.where("_partner").select("order_id").distinct().withColumn("_paid", F.lit(True))
    effect = last.join(paid, "order_id", "left")
    after = orders.join(effect, "order_id", "left").withColumns({
        "order_status": F.coalesce("_state", "order_status"),
        "payment_status": F.when(F.col("_paid"), "complete").otherwise(F.col("payment_status")),
    })
    cod = F.col("_paid") & (F.lower("method") == "cod")
    settled = spread_join(payments, paid, ["order_id"], ["method"]).withColumn(
        "status", F.when(cod, "complete").otherwise(F.col("status"))
    )
    tracking = counted.where("not _partner").select("order_id", F.col("state").alias("status"), "seq")
    return after.select(*orders.columns), settled.select(*payments.columns), tracking


def coupon_apply_changes(coupons: DataFrame, changes: DataFrame) -> DataFrame:
    """Coupons after creations and deletions.

    ``changes``: seq, op (``create``/``delete``), coupon_id, coupon_code,
    discount_type, discount_value, min_order_value, max_discount, expiry_date.
    A code in use is refused, and of several creations of one code the first
    counts; codes are kept in upper case. A deletion also removes a coupon that
    was created before it in the same batch.
    """
    columns = ["coupon_code", "discount_type", "discount_value", "min_order_value", "max_discount",
               "expiry_date", "is_active"]
    made = changes.where(F.col("op") == "create").select(
        "seq", "coupon_id", F.upper("coupon_code").alias("coupon_code"), "discount_type", "discount_value",
        F.coalesce("min_order_value", F.lit(0).cast("decimal(10,2)")).alias("min_order_value"),
        F.nullif("max_discount", F.lit(0)).alias("max_discount"), "expiry_date",
        F.lit(True).alias("is_active"),
    )
    first = first_per(made, ["coupon_code"], ["coupon_id", *columns[1:]])
    created = first.join(coupons.select("coupon_code"), "coupon_code", "left_anti")
    deleted = changes.where(F.col("op") == "delete").groupBy("coupon_id").agg(F.max("seq").alias("_gone"))
    kept = coupons.select("coupon_id", *columns).join(deleted, "coupon_id", "left_anti")
    stayed = created.join(deleted, "coupon_id", "left").where(F.col("_gone").isNull() | (F.col("_gone") < F.col("seq")))
    return kept.unionByName(stayed.select("coupon_id", *columns))


def coupon_usage_append(usage: DataFrame, coupons: DataFrame, orders: DataFrame) -> DataFrame:
    """Usage after orders with a coupon code: one use per coupon and user, unknown codes ignored.

    ``orders``: order_id, user_id, coupon_code; the first order of a pair counts.
    """
    used = (
        orders.where("coupon_code is not null and coupon_code <> ''")
        .groupBy("coupon_code", "user_id").agg(F.min("order_id").alias("order_id"))
        .join(coupons.select("coupon_id", "coupon_code"), "coupon_code")
        .select("coupon_id", "user_id", "order_id")
    )
    new = used.join(usage, ["coupon_id", "user_id"], "left_anti")
    return usage.select("coupon_id", "user_id", "order_id").unionByName(new)


def favourite_toggle(favourites: DataFrame, toggles: DataFrame) -> DataFrame:
    """Favourites after toggles: a pair is in if it was in and was toggled evenly, or was out and oddly."""
    keys = ["user_id", "product_id"]
    odd = toggles.groupBy(*keys).agg((F.count(F.lit(1)) % 2).alias("_odd")).where(F.col("_odd") == 1)
    held = favourites.select(*keys).withColumn("_held", F.lit(True))
    return (
        held.join(odd, keys, "full")
        .where(F.col("_held").isNull() | F.col("_odd").isNull())
        .select(*keys)
    )


def address_apply_changes(addresses: DataFrame, changes: DataFrame, editable: Sequence[str]) -> DataFrame:
    """Addresses after inserts, partial updates and deletions by their owner.

    ``changes``: seq, op (``insert``/``update``/``delete``), address_id,
    user_id, ``given`` (names of the columns sent) and the columns. A column
    that was not sent keeps its value, one that was sent as NULL becomes NULL.
    All updates of an address take part: each column takes its last sent value.
    Changes to an address that the batch inserts count if they come after that.
    """
    columns = list(editable)
    keys = ["address_id", "user_id"]
    inserted = changes.where(F.col("op") == "insert").select(
        *[F.col(c) if c in changes.columns else F.lit(None).cast(addresses.schema[c].dataType).alias(c)
          for c in addresses.columns]
    )
    made = changes.where(F.col("op") == "insert").groupBy(*keys).agg(F.max("seq").alias("_made"))
    later = changes.where(F.col("op") != "insert").join(made, keys, "left").where(
        F.col("_made").isNull() | (F.col("_made") < F.col("seq")))
    sent = {
        c: F.max(F.when((F.col("op") == "update") & F.array_contains("given", c), F.struct("seq", F.col(c).alias("v"))))
        for c in columns
    }
    effect = later.groupBy(*keys).agg(
        F.max(F.col("op") == "delete").alias("_gone"), *[agg.alias(f"_{c}") for c, agg in sent.items()]
    )
    # Joined on address and user, a change by anyone but the owner meets nothing.
    kept = addresses.unionByName(inserted).join(effect, keys, "left").where(~F.coalesce("_gone", F.lit(False)))
    return kept.select(
        *[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c) if c in columns
          else F.col(c) for c in addresses.columns]
    )


def default_address_set(addresses: DataFrame, choices: DataFrame) -> DataFrame:
    """Addresses after users chose a default: the chosen one is it, the user's others are not.

    ``choices``: seq, user_id, address_id; a choice of someone else's address is ignored.
    """
    own = choices.join(addresses.select("address_id", "user_id"), ["address_id", "user_id"], "left_semi")
    last = latest(own, ["user_id"], ["seq"], [F.col("address_id").alias("_chosen")])
    chosen = F.col("_chosen")
    return spread_join(addresses, last, ["user_id"], ["address_id"]).withColumn(
        "is_default", F.when(chosen.isNull(), F.col("is_default")).otherwise(F.col("address_id") == chosen)
    ).select(*addresses.columns)


def profile_update(addresses: DataFrame, changes: DataFrame) -> DataFrame:
    """Name and phone of the default addresses of users who edited their profile."""
    last = latest(changes, ["user_id"], ["seq"], [F.col("name").alias("_name"), F.col("phone").alias("_phone")])
    edited = F.col("_hit") & F.col("is_default")
    return spread_join(addresses, last.withColumn("_hit", F.lit(True)), ["user_id"], ["address_id"]).withColumns({
        "name": F.when(edited, F.col("_name")).otherwise(F.col("name")),
        "phone": F.when(edited, F.col("_phone")).otherwise(F.col("phone")),
    }).select(*addresses.columns)


def review_insert_once(reviews: DataFrame, submitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reviews with the first submitted review of each user who had none."""
    first = first_per(submitted, ["user_id"], columns)
    fresh = first.join(reviews.select("user_id"), "user_id", "left_anti")
    return reviews.select("user_id", *columns).unionByName(fresh.select("user_id", *columns))


def partner_apply_changes(partners: DataFrame, changes: DataFrame) -> DataFrame:
    """Delivery partners after creations, updates and deletions.

    ``changes``: seq, op (``create``/``update``/``delete``), driver_id (the
    new key for a creation), full_name, mobile, status. A mobile number in
    use refuses a creation; a new partner is active. Changes to a partner that
    the batch creates count if they come after that.
    """
    columns = ["full_name", "mobile", "status"]
    asked = changes.where(F.col("op") == "create")
    created = (
        first_per(asked, ["mobile"], ["driver_id", "full_name"])
        .join(partners.select("mobile"), "mobile", "left_anti")
        .withColumn("status", F.lit(1))
    )
    made = created.select("driver_id", F.col("seq").alias("_made"))
    edits = (
        changes.where(F.col("op") != "create").withColumn("op", F.when(F.col("op") == "delete", "delete").otherwise("put"))
        .join(made, "driver_id", "left").where(F.col("_made").isNull() | (F.col("_made") < F.col("seq"))).drop("_made")
    )
    everyone = partners.select("driver_id", *columns).unionByName(created.select("driver_id", *columns))
    return merge(everyone, edits, ["driver_id"], columns, upsert=False)


def walkin_customer_append(users: DataFrame, customers: DataFrame) -> DataFrame:
    """Sign-ups with customers added at the counter.

    ``customers``: user_id, name, phone, email.
    """
    added = customers.select("user_id", "name", "phone", "email", F.lit("admin").alias("added_by"),
                             F.lit("user").alias("user_role"))
    return users.select(*added.columns).unionByName(added)


def touch_updated_at(before: DataFrame, after: DataFrame, keys: Sequence[str], watched: Sequence[str],
                     now: Column) -> DataFrame:
    """``after`` with ``updated_at`` set to now on rows that the batch changed or added."""
    old = before.select(*keys, F.struct(*watched).alias("_old"), F.col("updated_at").alias("_kept"))
    same = F.col("_old") == F.struct(*watched)
    return after.drop("updated_at").join(old, list(keys), "left").withColumn(
        "updated_at", F.when(same, F.col("_kept")).otherwise(now)
    ).drop("_old", "_kept")


# --- cart -----------------------------------------------------------------
#
# A run of cart actions on one product is a function of the cart line before
# it. Five numbers say it all: what comes out of an empty line (``on``,
# ``qty``), and out of an active one (``kind`` off/add/put, ``amount``).
# Two runs combine into one, so runs are folded in stretches of the action
# number first and the stretches after that; no task sees all actions of a
# busy product.

CART_STEP = "struct<on: boolean, qty: bigint, kind: string, amount: bigint>"


def _cart_step(on: Column, qty: Column, kind: Column, amount: Column) -> Column:
    return F.struct(
        on.alias("on"), qty.cast("long").alias("qty"), kind.alias("kind"), amount.cast("long").alias("amount")
    )


def cart_steps(actions: DataFrame) -> DataFrame:
    """Each action as a step: add raises or opens, set changes an open line, reorder opens, remove closes."""
    op, zero, yes, no = F.col("op"), F.lit(0), F.lit(True), F.lit(False)
    # A quantity of zero or none means one when adding, and no change when setting.
    given = F.coalesce(F.nullif("qty", zero), F.lit(1))
    step = (
        F.when(op == "add", _cart_step(yes, given, F.lit("add"), given))
        .when(op == "reorder", _cart_step(yes, F.col("qty"), F.lit("put"), F.col("qty")))
        .when((op == "set") & (F.coalesce("qty", zero) != 0), _cart_step(no, zero, F.lit("put"), F.col("qty")))
        .when(op.isin("remove", "clear"), _cart_step(no, zero, F.lit("off"), zero))
    )
    return actions.withColumn("step", step).where("step is not null")


def _then(first: Column, second: Column) -> Column:
    """One step that does ``first`` and then ``second``."""
    def applied(active: Column, qty: Column) -> tuple[Column, Column]:
        out_on = F.when(active, second["kind"] != "off").otherwise(second["on"])
        out_qty = (
            F.when(active & (second["kind"] == "add"), qty + second["amount"])
            .when(active, second["amount"])
            .otherwise(second["qty"])
        )
        return out_on, out_qty

    on, qty = applied(first["on"], first["qty"])
    put_on, put_qty = applied(first["kind"] != "off", first["amount"])
    plain_add = (first["kind"] == "add") & (second["kind"] == "add")
    still_add = plain_add
    kind = F.when(still_add, "add").when(put_on, "put").otherwise("off")
    amount = F.when(still_add, first["amount"] + second["amount"]).otherwise(put_qty)
    return _cart_step(on, qty, kind, amount)


def _fold_steps(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One step per key, folded in order. Callers see to it that a key has few rows."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.col("step").alias("_step"))))
    nothing = _cart_step(F.lit(False), F.lit(0), F.lit("add"), F.lit(0))
    return (
        rows.groupBy(*keys).agg(steps.alias("_steps"))
        .withColumn("step", F.aggregate("_steps", nothing, lambda done, row: _then(done, row["_step"])))
        .drop("_steps")
    )


def fold_cart(steps: DataFrame, seq: str = "seq", bits: int = 16) -> DataFrame:
    """One step per user and product out of steps with a unique whole-number ``seq``.

    A fold sees at most ``2 ** bits`` rows, however many a pair has.
    """
    keys = ["user_id", "product_id"]
    rows = steps.select(*keys, F.col(seq).alias("_n"), "step")
    for _ in range(2):
        rows = rows.withColumn("_stretch", stretch("_n", bits))
        rows = _fold_steps(rows, [*keys, "_stretch"], "_n").withColumnRenamed("_stretch", "_n")
    return _fold_steps(rows, keys, "_n")


def cart_merge(cart: DataFrame, actions: DataFrame) -> DataFrame:
    """Cart lines after a batch of actions, one row per user and product.

    ``cart``: user_id, product_id, quantity, status; ``actions``: seq (unique),
    user_id, product_id (NULL for ``clear``), op and qty. A clear closes all
    lines of its user.
    """
    keys = ["user_id", "product_id"]
    cleared = (
        actions.where(F.col("op") == "clear").groupBy("user_id").agg(F.max("seq").alias("_cleared"))
    )
    steps = cart_steps(actions.where((F.col("op") != "clear") & F.col("product_id").isNotNull()))
    # What a user did before the last clear leaves closed lines only.
    mine = spread_join(steps, cleared, ["user_id"], ["seq"])
    live = mine.where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
    folded = fold_cart(live.drop("_cleared"))
    opened = steps.where(F.col("op").isin("add", "reorder")).select(*keys).distinct()

    before = cart.join(cleared.select("user_id", F.lit(True).alias("_cleared")), "user_id", "left").select(
        *keys, "quantity", ((F.col("status") == "active") & F.col("_cleared").isNull()).alias("_on"),
    )
    lines = before.join(opened.withColumn("_opened", F.lit(True)), keys, "full").join(folded, keys, "full")
    was_on = F.coalesce("_on", F.lit(False))
    qty = F.coalesce("quantity", F.lit(0)).cast("long")
    step = F.col("step")
    on = F.when(step.isNull(), was_on).when(was_on, step["kind"] != "off").otherwise(step["on"])
    after = (
        F.when(step.isNull(), qty)
        .when(was_on & (step["kind"] == "add"), qty + step["amount"])
        .when(was_on, step["amount"])
        .otherwise(step["qty"])
    )
    return lines.where(F.col("_on").isNotNull() | F.col("_opened").isNotNull()).select(
        *keys, F.when(on, after).alias("quantity"), F.when(on, "active").otherwise("removed").alias("status")
    )

"""Coupons, carts, checkout, delivery slots and code checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import hmac_sha256, order_number
from storelens.functions.keyed import hot_keys, minute_of, moment_of, spread_join, stretch, with_shares
from storelens.sources.tables import Tables


def active_coupons(coupons: DataFrame, as_of: dt.date) -> DataFrame:
    """Coupons that are on and not past their last day."""
    open_ended = F.col("expiry_date").isNull() | (F.col("expiry_date") >= F.lit(as_of))
    return coupons.where(F.col("is_active") & open_ended)


def coupon_list_with_usage(t: Tables, user_id: int) -> DataFrame:
    """Coupons that are on, with a mark on those the user has used."""
    used = t.coupon_usage.where(F.col("user_id") == user_id).select("coupon_id", F.lit(True).alias("_used"))
    return t.coupons.where("is_active").join(used, "coupon_id", "left").select(
        "coupon_id", "coupon_code", "discount_type", "discount_value", "min_order_value", "max_discount",
        "expiry_date", "is_active", F.coalesce("_used", F.lit(False)).alias("is_used"),
    )


def coupon_uses(t: Tables) -> DataFrame:
    """The marks of all users: one row per user and used coupon that is on. Any other pair is unused."""
    return t.coupon_usage.join(t.coupons.where("is_active"), "coupon_id").select(
        "user_id", "coupon_id", "coupon_code", "order_id", F.lit(True).alias("is_used")
    )


def apply_coupon(t: Tables, carts: DataFrame, as_of: dt.date) -> DataFrame:
    """Discount of the coupon entered for each cart, or the first reason against it.

    ``carts`` has cart_id, user_id, coupon_code and cart_total.
    """
    offered = active_coupons(t.coupons, as_of).select(
        "coupon_id", F.col("coupon_code").alias("_code"), "discount_type", "discount_value",
        "min_order_value", F.nullif("max_discount", F.lit(0)).alias("_cap"),
    )
    used = t.coupon_usage.select("coupon_id", "user_id").distinct().withColumn("_used", F.lit(True))
    reason = (
        F.when(F.col("coupon_id").isNull(), "invalid")
        .when(F.col("cart_total") < F.col("min_order_value"), "below_minimum")
        .when(F.col("_used"), "used")
    )
    percent = F.col("cart_total") * F.col("discount_value") * F.lit("0.01").cast("decimal(3,2)")
    discount = F.when(F.col("discount_type") == "PERCENT", F.least(percent, F.coalesce("_cap", percent)))
    entered = carts.join(offered, F.upper("coupon_code") == F.col("_code"), "left")
    return (
        spread_join(entered, used, ["coupon_id", "user_id"], ["cart_id"], base=carts, hot_on=["user_id"])
        .withColumn("reason", reason)
        .select(
            "cart_id", "user_id", "cart_total", "reason",
            F.when(F.col("reason").isNull(), F.col("coupon_id")).alias("coupon_id"),
            F.when(F.col("reason").isNull(), discount.otherwise(F.col("discount_value")))
            .cast("decimal(18,4)").alias("discount"),
        )
    )


def checkout_price(t: Tables, carts: DataFrame, as_of: dt.date, first_order: int = 100,
                   history: DataFrame | None = None) -> DataFrame:
    """Payable amount of each cart whose coupon holds: welcome discount first, then the coupon.

    ``history`` is the order table the welcome discount looks at.
    """
    orders = t.orders if history is None else history
    ordered = orders.select("user_id").distinct().withColumn("_ordered", F.lit(True))
    total, zero = F.col("cart_total"), F.lit(0).cast("decimal(18,4)")
    welcome = F.when(F.col("_ordered"), zero).otherwise(F.lit(first_order).cast("decimal(18,4)"))
    granted = apply_coupon(t, carts, as_of).where(F.col("reason").isNull())
    return (
        spread_join(granted, ordered, ["user_id"], ["cart_id"], base=carts)
        .withColumn("first_order_discount", F.least(welcome, total))
        .withColumn("coupon_discount",
                    F.least(F.coalesce("discount", zero), total - F.col("first_order_discount")))
        .select(
            "cart_id", "coupon_id", "cart_total",
            F.col("first_order_discount").cast("decimal(18,4)").alias("first_order_discount"),
            F.col("coupon_discount").cast("decimal(18,4)").alias("coupon_discount"),
            F.greatest(total - F.col("first_order_discount") - F.col("coupon_discount"), zero)
            .cast("decimal(18,4)").alias("to_pay"),
        )
    )


def cart_bill(t: Tables, handling_fee: int = 0, delivery_fee: int = 0) -> DataFrame:
    """Bill of each user's active cart; users without one get zeros."""
    lines = (
        t.cart.where(F.col("status") == "active")
        .groupBy("user_id", "product_id").agg(F.sum("quantity").alias("_qty"))
        .join(t.products.select("product_id", "price"), "product_id", "left")
    )
    totals = lines.groupBy("user_id").agg(
        F.sum(F.coalesce(F.col("price") * F.col("_qty"), F.lit(0))).alias("_total")
    )
    fee = lambda amount: F.when(F.col("_total").isNull(), 0).otherwise(amount)
    return t.users.select("user_id").join(totals, "user_id", "left").select(
        "user_id", F.coalesce("_total", F.lit(0)).cast("decimal(18,2)").alias("item_total"),
        fee(handling_fee).alias("handling_fee"), fee(delivery_fee).alias("delivery_fee"),
        (F.coalesce("_total", F.lit(0)) + fee(handling_fee) + fee(delivery_fee))
        .cast("decimal(18,2)").alias("to_pay"),
    )


def _slot_table() -> list[tuple[int, list[tuple[int, str, str]]]]:
    """For each half hour from which slots may start, the slots as minute of the day asked on, day and label."""
    def clock(minutes: int) -> str:
        hour, minute = minutes // 60 % 24, minutes % 60
        return f"{(hour + 11) % 12 + 1}:{minute:02d} {'am' if hour < 12 else 'pm'}"

    def named(begins: int) -> tuple[int, str, str]:
        day = "Today" if begins < 1440 else "Tomorrow"
        return begins, day, f"{day}, {clock(begins)} - {clock(begins + 60)}"

    # Half past eight as the end of today, ten to twenty hours for tomorrow.
    tomorrow = [1440 + hour * 60 for hour in range(10, 20)]
    return [(first, [named(m) for m in [*range(first, 20 * 60 + 30 - 60 + 1, 60), *tomorrow]])
            for first in range(30, 24 * 60 + 1, 30)]


def delivery_slots(requests: DataFrame) -> DataFrame:
    """One-hour delivery slots offered at the time of each request.

    ``requests`` has request_id and requested_at. Today runs from the next
    half hour to 20:30, tomorrow from 10:00 to 20:00. Slots depend on the half
    hour alone, so they come from a table of 48 rows.
    """
    at = F.col("requested_at")
    first = F.hour(at) * 60 + F.when(F.minute(at) <= 30, 30).otherwise(60)
    table = requests.sparkSession.createDataFrame(
        _slot_table(), "_first int, _slots array<struct<begins: int, day: string, label: string>>")
    return (
        requests.select("request_id", F.to_date(at).cast("timestamp_ntz").alias("_day"), first.alias("_first"))
        .join(F.broadcast(table), "_first")
        .select("request_id", "_day", F.inline("_slots"))
        .select(
            "request_id", "day", (F.col("_day") + F.make_dt_interval(mins=F.col("begins"))).alias("slot_start"),
            (F.col("_day") + F.make_dt_interval(mins=F.col("begins") + 60)).alias("slot_end"), "label")
    )


def payment_signature_audit(payments: DataFrame, secret: str) -> DataFrame:
    """Does the signature of each payment fit its order and payment reference?"""
    message = F.concat_ws("|", "order_ref", "payment_ref")
    return payments.withColumn("expected", hmac_sha256(message, secret)).withColumn(
        "is_valid", F.coalesce(F.col("expected") == F.col("signature"), F.lit(False))
    )


def otp_match(issues: DataFrame, attempts: DataFrame,
              valid_for: dt.timedelta | None = dt.timedelta(minutes=5)) -> DataFrame:
    """Check each code attempt against the latest code issued before it.

    Both inputs have user_id, at, seq and code. A code holds for ``valid_for``
    (None: for ever) and for one success. An attempt without a code fits none,
    one without a user has no code. The latest code is looked up within the
    minute of the attempt, and across minutes through one row per user and
    minute. A minute that holds too many rows of a user is cut into runs, by
    the moment and, for rows of one moment, by stretches of ``seq``; the last
    code of each run is carried over to the next ones.
    """
    columns = ("user_id", "at", "seq", "code")
    rows = (
        issues.select(*columns, F.lit(True).alias("_issue"))
        .unionByName(attempts.select(*columns, F.lit(False).alias("_issue")))
        .where(F.col("user_id").isNotNull())
        .withColumn("_minute", minute_of("at"))
    )
    minute, run = ["user_id", "_minute"], ["_moment", "_stretch"]
    busy = F.col("_shares").isNotNull()
    rows = with_shares(rows, hot_keys(rows, minute), minute).withColumns({
        "_busy": busy, "_moment": F.when(busy, moment_of("at")).otherwise(0), "_stretch": F.when(busy, stretch("seq")).otherwise(0)})
    issued = F.when(F.col("_issue"), F.struct("at", "seq", "code"))
    runs = rows.groupBy(*minute, *run, "_busy").agg(F.max(issued).alias("_last"))

    def carried(keys: list[str], level: str) -> DataFrame:
        """The last code before each step of a level, within what the keys name."""
        earlier = W.partitionBy(*keys).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        steps = rows.where("_busy") if keys != ["user_id"] else rows
        return steps.groupBy(*keys, level).agg(F.max(issued).alias("_last")).select(
            *keys, level, F.last("_last", ignorenulls=True).over(earlier).alias(f"_before{level}"))

    before_run = (
        runs.join(carried([*minute, "_moment"], "_stretch"), [*minute, *run], "left")
        .join(carried(minute, "_moment"), [*minute, "_moment"], "left")
        .join(carried(["user_id"], "_minute"), minute)
        .select(*minute, *run, F.coalesce("_before_stretch", "_before_moment", "_before_minute").alias("_carried"))
    )
    before = W.partitionBy(*minute, *run).orderBy("at", "seq").rowsBetween(W.unboundedPreceding, -1)
    seen = (
        rows.withColumn("_recent", F.last(issued, ignorenulls=True).over(before))
        .where(~F.col("_issue"))
        .join(before_run, [*minute, *run])
        .withColumn("_code", F.coalesce("_recent", "_carried"))
    )
    in_time = F.lit(True)
    if valid_for is not None:
        in_time = F.col("_code.at") + F.lit(valid_for) > F.col("at")
    first_reason = (
        F.when(F.col("_code").isNull(), "no_code")
        .when(~F.coalesce(F.col("_code.code") == F.col("code"), F.lit(False)), "wrong_code")
        .when(~in_time, "expired")
    )
    checked = seen.withColumn("_reason", first_reason).withColumn("issue_seq", F.col("_code.seq"))
    # Of the attempts that fit one code, the first uses it up.
    winners = (
        checked.where(F.col("_reason").isNull())
        .groupBy("user_id", "issue_seq").agg(F.min(F.struct("at", "seq")).alias("_first"))
        .select(F.col("_first.seq").alias("seq"), F.lit(True).alias("_won"))
    )
    nobody = attempts.where(F.col("user_id").isNull()).select(
        "user_id", "seq", "at", F.lit(None).cast(issues.schema["seq"].dataType).alias("issue_seq"), F.lit("no_code").alias("outcome"))
    return checked.join(winners, "seq", "left").select(
        "user_id", "seq", "at", "issue_seq",
        F.when(F.col("_won"), "matched").otherwise(F.coalesce("_reason", F.lit("used"))).alias("outcome"),
    ).unionByName(nobody)


def normalize_order_id(t: Tables) -> DataFrame:
    """Order numbers read back as numbers."""
    return t.orders.select("order_no", order_number(F.col("order_no")).alias("number"))


ADDRESS_COMPONENTS = "array<struct<types: array<string>, long_name: string>>"


def address_components(documents: DataFrame) -> DataFrame:
    """Street, area, city and postcode out of a geocoder answer.

    ``documents`` has document_id and ``components``, JSON text.
    """
    parsed = F.from_json("components", ADDRESS_COMPONENTS)

    def found(kind: str) -> Column:
        named = F.filter("c", lambda part: F.array_contains(part["types"], kind))
        return F.nullif(F.get(named, F.lit(0))["long_name"], F.lit(""))

    street = found("route")
    area = F.coalesce(found("sublocality_level_1"), found("sublocality"), found("locality"), street)
    city = F.coalesce(found("locality"), found("administrative_area_level_2"))
    blank = F.lit("")
    return documents.select("document_id", parsed.alias("c")).select(
        "document_id", F.coalesce(street, blank).alias("street"), F.coalesce(area, blank).alias("area"),
        F.coalesce(city, blank).alias("city"), F.coalesce(found("postal_code"), blank).alias("pincode"),
    )

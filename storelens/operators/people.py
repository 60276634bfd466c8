"""Addresses, customers and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import contains_text
from storelens.functions.keyed import By, latest, moment_of, newest_first, only_shown, page, ranked, stretch
from storelens.sources.tables import Tables


def latest_address_per_user(addresses: DataFrame, *columns: str) -> DataFrame:
    """The address with the highest key of each user."""
    return latest(addresses, ["user_id"], ["address_id"], columns or ["address_id", "name", "city"])


def newest_address_by_time(addresses: DataFrame, *columns: str) -> DataFrame:
    """The newest address of each user by creation time, ties broken by key."""
    order = [*newest_first("created_at"), "address_id"]
    return latest(addresses, ["user_id"], order, columns or ["address_id", "name", "city"])


def address_book(t: Tables) -> DataFrame:
    """Addresses of each user with their place in the book: default first, then newest.

    A missing flag or time sorts before all others.
    """
    flag = F.when(F.col("is_default").isNull(), 0).when(F.col("is_default"), 1).otherwise(2)
    long_past = F.lit(-(2 ** 62))
    return ranked(
        t.addresses.select("user_id", "address_id", "name", "is_default", "created_at"),
        by=["user_id"],
        order=[F.col("is_default").desc_nulls_first(), F.col("created_at").desc_nulls_first(),
               F.col("address_id").desc()],
        bucket={"_flag": flag, "_moment": F.coalesce(-moment_of("created_at"), long_past),
                "_stretch": -stretch("address_id")},
    )


def order_summary(orders: DataFrame) -> DataFrame:
    """Order count, money spent and last order of each user."""
    return orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_spent"),
        F.max("created_at").alias("last_order"),
    )


# Orders of the listings.
CUSTOMER_ORDER = [By("user_id", falling=True)]
DRIVER_ORDER = [By("created_at", falling=True), By("driver_id", falling=True)]


def customer_list(t: Tables, search: str = "", number: int = 1, size: int | None = None,
                  after: Sequence | None = None) -> DataFrame:
    """Users by their latest address, with order count and date of the last order."""
    people = latest_address_per_user(t.addresses, "name", "phone", "full_address")
    people = people.where(contains_text("name", search))
    people = page(people, CUSTOMER_ORDER, number, size, after)
    orders = only_shown(t.orders, people, "user_id", size).groupBy("user_id").agg(
        F.count("order_id").alias("total_orders"), F.max("created_at").alias("last_order")
    )
    return people.join(orders, "user_id", "left").select(
        F.col("user_id").alias("id"), "name", "phone", "full_address",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce(F.date_format("last_order", "yyyy-MM-dd"), F.lit("—")).alias("last_order"),
    )


def customer_directory(t: Tables) -> DataFrame:
    """All sign-ups with their order summary; app users show name and city of their newest address."""
    newest = newest_address_by_time(t.addresses, F.col("name").alias("address_name"), F.col("city").alias("address_city"))
    app = F.col("added_by") == "app"
    return (
        t.users.join(newest, "user_id", "left")
        .join(order_summary(t.orders), "user_id", "left")
        .select(
            "user_id",
            F.when(app, F.coalesce(F.nullif("address_name", F.lit("")), F.col("name")))
            .otherwise(F.col("name")).alias("name"),
            "phone", "email", "added_by",
            F.when(app, F.col("address_city")).alias("city"),
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            F.coalesce("total_spent", F.lit(0)).alias("total_spent"),
            "last_order",
        )
    )


def customer_details(t: Tables) -> DataFrame:
    """Order summary and newest address of every user."""
    newest = newest_address_by_time(t.addresses, F.col("name").alias("address_name"), F.col("city").alias("address_city"))
    return (
        t.users.select("user_id")
        .join(order_summary(t.orders), "user_id", "left")
        .join(newest, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            F.coalesce("total_spent", F.lit(0)).alias("total_spent"),
            "last_order", "address_name", "address_city",
        )
    )


def review_status(t: Tables) -> DataFrame:
    """Has the user left a review?"""
    done = t.reviews.select("user_id").distinct().withColumn("_done", F.lit(True))
    return t.users.select("user_id").join(done, "user_id", "left").select(
        "user_id", F.coalesce("_done", F.lit(False)).alias("is_reviewed")
    )


def tag_counts(reviews: DataFrame) -> DataFrame:
    """How often each review tag was given."""
    return reviews.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("reviews"))


def first_order_discount(t: Tables, before: Column | None = None, amount: int = 100) -> DataFrame:
    """Welcome discount of users who have no order yet (none before ``before``)."""
    orders = t.orders if before is None else t.orders.where(F.col("created_at") < before)
    counts = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("_orders"))
    return t.users.select("user_id").join(counts, "user_id", "left").select(
        "user_id", F.when(F.coalesce("_orders", F.lit(0)) == 0, amount).otherwise(0).alias("discount")
    )


def driver_list(t: Tables, number: int = 1, size: int | None = None, after: Sequence | None = None) -> DataFrame:
    """Delivery partners, newest first; one without a date counts as newest."""
    drivers = t.partners.select("driver_id", "full_name", "mobile", "status", "created_at")
    return page(drivers, DRIVER_ORDER, number, size, after)

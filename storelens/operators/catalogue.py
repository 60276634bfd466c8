"""Products, categories, search, deals and recommendations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import contains_text, percent_off, status_label
from storelens.functions.keyed import By, moment_of, only_shown, page
from storelens.operators.images import first_image_per_product
from storelens.operators.stock import DEFAULT_OPEN_DATE, with_movement, with_stock
from storelens.sources.tables import Tables
from storelens.sources.tenancy import register, rows_of


# Sizes of the reports that list the first so many rows, and the
# product kinds of the home screen as they are stored.
SEARCH_ROWS = 30
POPULAR_TAGS = 10
RECOMMENDED_PRODUCTS = 12
VEGETABLE, FRUIT = "vegitable", "fruit"


def tenant_scan(t: Tables, table: str, register_id: int | None = None) -> DataFrame:
    """Rows of a table that belong to one store, or, for a table that names the store, to any registered one.

    A store that is not registered is an error. ``tenancy.store_tables`` gives
    all tables of a store to any operator.
    """
    if register_id is not None:
        return rows_of(t, table, register(t, register_id))
    return getattr(t, table).join(t.tenants, "register_id")


def category_filter(t: Tables, mode_fetchorall: int = 0, category_id: int | None = None) -> DataFrame:
    """All categories, or one if the mode is 1."""
    if mode_fetchorall == 1:
        return t.categories.where(F.col("categories_id") == category_id)
    return t.categories


def unit_list(t: Tables) -> DataFrame:
    return t.units.select("unitid", "unitname", "unitshortcode")


def title_search(t: Tables, text: str) -> DataFrame:
    """Products whose title contains the text; a product without a title never matches."""
    return t.products.where(contains_text("title", text)).select("product_id", "title")


def product_status(t: Tables) -> DataFrame:
    """Products with the label of their status."""
    return t.products.select("product_id", status_label("itmsts", 1, "Active", "In-Active").alias("status"))


def product_options(t: Tables) -> DataFrame:
    """Products of a known unit for a picker, one row per product."""
    return (
        t.products.join(t.units, F.col("unit") == F.col("unitid"))
        .groupBy(F.col("product_id").alias("item_id"))
        .agg(F.min_by(F.struct("title", "unitid", "unitname", "price"), "unitid").alias("o"))
        .select("item_id", F.col("o.title").alias("item_name"), F.col("o.unitid").alias("unit_id"),
                F.col("o.unitname").alias("unit_name"), F.col("o.price").alias("rate"))
    )


# Order of the listing.
CATALOGUE_ORDER = [By("product_id")]


def catalogue_list(t: Tables, search: str = "", number: int = 1, size: int | None = None,
                   after: Sequence | None = None) -> DataFrame:
    """Products of known category with one picture, by product."""
    products = t.products.where(contains_text("title", search)) if search else t.products
    names = t.categories.select("categories_id", F.col("categories_name").alias("category_name"))
    shown = page(products.join(names, "categories_id"), CATALOGUE_ORDER, number, size, after)
    images = only_shown(t.images, shown, "product_id", size)
    return shown.join(first_image_per_product(images), "product_id", "left").select(
        F.col("product_id").alias("id"), F.col("title").alias("name"), F.col("category_name").alias("category"),
        "categories_id", "price", "mrp", "description", "itmsts", "unit",
        status_label("itmsts", 1, "Active", "In-Active").alias("status"),
        "lowstqty", "openbalqty", "openbaldate", "discount_per", "discount_sts",
        F.col("itm_spctyp").alias("itmtype"), F.col("image_url").alias("image"),
    )


def category_items(t: Tables, category_id: int | None = None,
                   default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """Products of a category, or of all, with unit, stock and picture; unknown units left out."""
    products = t.products if category_id is None else t.products.where(F.col("categories_id") == category_id)
    products = products.join(t.units, F.col("unit") == F.col("unitid"))
    return (
        with_stock(t, products, default_open_date, category_id is not None)
        .join(first_image_per_product(t.images), "product_id", "left")
        .select("product_id", "categories_id", "title", "price", "mrp", "description",
                F.col("unitname").alias("unit"), F.col("stock").alias("current_stock"),
                F.col("image_url").alias("image"))
    )


def search_items(t: Tables, search: str = "", default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """Products found by title with category, picture and stock (NULL without an opening balance)."""
    products = t.products.where(contains_text("title", search)) if search else t.products
    names = t.categories.select("categories_id", F.col("categories_name").alias("category_name"))
    return (
        with_movement(t, products.join(names, "categories_id"), default_open_date, bool(search))
        .join(first_image_per_product(t.images), "product_id", "left")
        .select(
            F.col("product_id").alias("id"), F.col("title").alias("name"), F.col("category_name").alias("category"),
            "categories_id", "price", "mrp",
            (F.col("openbalqty") + F.coalesce("moved", F.lit(0))).alias("stock"),
            F.coalesce("image_url", F.lit("")).alias("image"),
        )
    )


def popular_tags(t: Tables, size: int = POPULAR_TAGS) -> DataFrame:
    """Category names offered next to a search."""
    return t.categories.orderBy("categories_id").limit(size).select("categories_name")


def global_search(t: Tables, text: str, size: int = SEARCH_ROWS) -> DataFrame:
    """Products, then categories, whose name contains the text: at most ``size`` of each."""

    def branch(found: DataFrame, key: str, name: str, label: str, url: str, nav: str) -> DataFrame:
        return (
            found.where(contains_text(name, text)).orderBy(key).limit(size)
            .select(F.col(key).cast("long").alias("id"), F.concat(F.col(name), F.lit(f"--({label})")).alias("name"),
                    F.lit(url).alias("url"), F.lit(nav).alias("nav"))
        )

    return branch(t.products, "product_id", "title", "Item", "search", "item").unionByName(
        branch(t.categories, "categories_id", "categories_name", "Category", "category", "category")
    )


def item_prices(t: Tables) -> DataFrame:
    """Plain (id, name, price) list that goes with the deals."""
    return t.products.select(F.col("product_id").alias("id"), F.col("title").alias("name"), "price")


def _on_offer() -> Column:
    return (F.col("discount_sts") == 1) & (F.col("discount_per") > 0)


def super_deals(t: Tables) -> DataFrame:
    """Products on offer with their reduced price."""
    percent = F.coalesce("discount_per", F.lit(0).cast("decimal(5,2)"))
    return t.products.where(_on_offer()).select(
        F.col("product_id").alias("id"), F.col("title").alias("name"), F.col("price").alias("original"),
        percent.alias("discount"), percent_off(F.col("price"), percent).cast("decimal(10,2)").alias("offer"),
    )


def deal_price(t: Tables, products: DataFrame | None = None, default_open_date: dt.date = DEFAULT_OPEN_DATE,
               *more: str) -> DataFrame:
    """Products as the home screen shows them: price now and before, unit, picture, stock."""
    chosen = products is not None
    products = products if chosen else t.products
    percent = F.coalesce("discount_per", F.lit(0).cast("decimal(5,2)"))
    price = F.when(F.coalesce("discount_sts", F.lit(0)) == 1, percent_off(F.col("price"), percent)).otherwise(F.col("price"))
    known = products.join(t.units, F.col("unit") == F.col("unitid"))
    return (
        with_stock(t, known, default_open_date, chosen)
        .join(first_image_per_product(t.images), "product_id", "left")
        .select(
            "product_id", F.col("title").alias("name"), percent.alias("discount"),
            price.cast("decimal(10,2)").alias("price"), F.col("price").alias("oldPrice"),
            F.col("image_url").alias("img"), F.col("unitname").alias("weight"),
            F.col("stock").alias("current_stock"),
            "discount_per", "discount_sts", "itm_spctyp", *more,
        )
    )


def ordered_categories(t: Tables) -> DataFrame:
    """Categories ever ordered, with their last order."""
    last = t.order_items.groupBy("product_id").agg(F.max("order_id").alias("last_order_id"))
    return (
        t.products.select("product_id", "categories_id").join(last, "product_id")
        .groupBy("categories_id").agg(F.max("last_order_id").alias("last_order_id"))
    )


def recommended_products(t: Tables, categories: int | None = None, size: int = RECOMMENDED_PRODUCTS) -> DataFrame:
    """First products, of a known unit, whose category was ever ordered; of the first ``categories`` only if given."""
    sold = t.products.join(t.order_items.select("product_id").distinct(), "product_id", "left_semi")
    chosen = sold.select("categories_id").distinct()
    if categories is not None:
        chosen = chosen.orderBy("categories_id").limit(categories)
    return (
        t.products.join(chosen, "categories_id", "left_semi")
        .join(t.units.select(F.col("unitid").alias("unit")), "unit", "left_semi")
        .orderBy("product_id").limit(size).select("product_id")
    )


_HOME_COLUMNS = ("product_id", "name", "discount", "price", "oldPrice", "img", "weight", "current_stock")


def recommendations(t: Tables, categories: int | None = None, size: int = RECOMMENDED_PRODUCTS,
                    default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """The recommended products as the home screen shows them."""
    chosen = recommended_products(t, categories, size)
    products = t.products.join(chosen, "product_id", "left_semi")
    return deal_price(t, products, default_open_date).select(*_HOME_COLUMNS)


def home_feed(t: Tables, default_open_date: dt.date = DEFAULT_OPEN_DATE) -> DataFrame:
    """Sections of the home screen: deals, vegetables, fruit and recommendations.

    Prices and stock are worked out once, for products of any section; a
    product then goes into each section it belongs to.
    """
    chosen = recommended_products(t).withColumn("_reco", F.lit(True))
    kind = F.coalesce("itm_spctyp", F.lit(""))
    sections = F.array_compact(F.array(
        F.when(_on_offer(), "deals"),
        F.when(kind == VEGETABLE, "veg"),
        F.when(kind == FRUIT, "fruit"),
        F.when(F.col("_reco"), "reco"),
    ))
    shown = (
        t.products.join(chosen, "product_id", "left")
        .withColumn("sections", sections)
        .where(F.size("sections") > 0)
    )
    return deal_price(t, shown, default_open_date, "sections").select(
        F.explode("sections").alias("section"), *_HOME_COLUMNS
    )


def favourites_list(t: Tables) -> DataFrame:
    """Favourites of all users with their product."""
    return t.favourites.join(t.products, "product_id").select(
        "user_id", "fav_id", "product_id", "title", "price", "unit", "thumbnail"
    )


def cart_list(t: Tables) -> DataFrame:
    """Active cart lines with product, price and thumbnail where the product is known."""
    products = t.products.select("product_id", F.col("title").alias("product_name"), "thumbnail", "price")
    return t.cart.where(F.col("status") == "active").join(products, "product_id", "left").select(
        "cart_id", "user_id", "product_id", "quantity", "product_name", "thumbnail", "price", "created_at"
    )


def flash_sale_items(t: Tables, register_id: int | None, as_of: dt.datetime) -> DataFrame:
    """Products on flash sale at a moment, of one store or of all; both ends of a sale count."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    sales = t.flash_sales.where(now.between(F.col("from_datetime"), F.col("to_datetime")))
    if register_id is not None:
        sales = sales.where(F.col("register_id") == register_id)
    return sales.join(t.flash_sale_lines, "flsh_trnid").join(t.products, "product_id").select(
        "register_id", "flsh_trnid", "product_id", "title", "product_rate", "from_datetime", "to_datetime"
    )


def flash_sale_orders(t: Tables) -> DataFrame:
    """Quantity ordered of each flash-sale product while its sale was on, both ends included.

    A sale's quantity is what was ordered up to its end less what was ordered before its start, so no order line meets
    a sale. Both ends stand among the product's moments and take the running sum there: first within their day, then,
    with one row left for each day, over the days before. Lines are summed by product and moment before they are sorted;
    a product has as many days as the calendar and a day as many moments as the clock, however often it is ordered.
    """
    offers = t.flash_sales.join(t.flash_sale_lines, "flsh_trnid").where("from_datetime <= to_datetime")
    ends = offers.select("flsh_trnid", "product_id", F.inline(F.array(
        F.struct(F.col("to_datetime").alias("at"), F.lit(1).alias("sign")),
        F.struct(F.expr("from_datetime - interval '0.000001' second").alias("at"), F.lit(-1).alias("sign")))))
    times = t.orders.where("created_at is not null").select("order_id", F.col("created_at").alias("at"))
    names = ("qty", "lines")
    moments = (
        t.order_items.select("order_id", "product_id", "product_qty")
        .join(offers.select("product_id").distinct(), "product_id", "left_semi").join(times, "order_id")
        .groupBy("product_id", "at").agg(F.sum(F.coalesce("product_qty", F.lit(0))).alias("qty"), F.count(F.lit(1)).alias("lines"))
    )
    both = moments.unionByName(ends, allowMissingColumns=True).select(
        "product_id", "flsh_trnid", "sign", F.struct(*names).alias("v"), F.unix_date(F.to_date("at")).alias("_day"), moment_of("at").alias("_at"))
    day = W.partitionBy("product_id", "_day").orderBy("_at")
    until = day.rangeBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("product_id").orderBy("_day").rangeBetween(W.unboundedPreceding, -1)
    # The running sum at the last row of a day is that of the whole day.
    before = {n: F.coalesce(F.sum(F.when(F.col("_last"), F.col(n))).over(earlier), F.lit(0)) for n in names}
    found = (
        both.withColumns({n: F.coalesce(F.sum(f"v.{n}").over(until), F.lit(0)) for n in names})
        .withColumn("_last", F.lead("_at").over(day).isNull())
        .where("_last or sign is not null")
        .withColumns({n: F.col("sign") * (F.col(n) + before[n]) for n in names})
        .where("sign is not null")
    )
    return found.groupBy("flsh_trnid", "product_id").agg(*[F.sum(n).alias(n) for n in names]).where("lines > 0").select(
        "flsh_trnid", "product_id", F.col("qty").alias("sold_qty"))


def row_totals(t: Tables) -> DataFrame:
    """Row counts that go with the paged listings."""

    def total(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("listing"), "total")

    return (
        total("orders", t.orders)
        .unionByName(total("customers", t.users.where(F.col("user_role") == "user")))
        .unionByName(total("items", t.products))
        .unionByName(total("purchases", t.purchases))
    )


def missing_members(staged: DataFrame, staged_column: str, master: DataFrame, master_column: str) -> DataFrame:
    """Distinct trimmed values of a staged column that the master column lacks.

    A missing value counts as lacking, once.
    """
    wanted = staged.select(F.trim(staged_column).alias("member")).distinct()
    known = master.select(F.trim(master_column).alias("member"))
    return wanted.join(known, "member", "left_anti")


def distinct_members(staged: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed values of a column."""
    return staged.select(F.trim(column).alias("member")).distinct()

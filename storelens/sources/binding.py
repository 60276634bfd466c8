"""Logical tables derived from the supplied Parquet star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.tables import TABLE_NAMES, Tables

# Columns of the supplied files. Stated here so that opening a table reads no file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
                " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
}

# A key read off the name itself, so that no table-wide numbering is needed.
CATEGORY_KEY = "ascii(p_type) * 100 + length(p_type)"
PRICE = "cast(p_retailprice as decimal(10,2))"
INWARD = "(l_returnflag = 'R' or (l_returnflag = 'A' and l_linestatus = 'F'))"


class StarSchema:
    """Opens the supplied files and relabels them as retail tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def tenants(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "n_nationkey as register_id", "n_name as store_name", "n_regionkey as region_id")

    def users(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as user_id", "c_name as name",
            "concat('9', lpad(cast(c_custkey as string), 9, '0')) as phone",
            "concat(lower(c_mktsegment), c_custkey, '@example.com') as email",
            "if(c_custkey % 2 = 0, 'app', 'admin') as added_by", "'user' as user_role",
            "c_nationkey as register_id")

    def addresses(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as address_id", "user_id", "event_type as name",
            "concat('8', lpad(cast(event_id % 100000 as string), 9, '0')) as phone",
            "case when value >= 5 then cast(cast(floor(value) as int) as string) end as city",
            "case when event_id % 6 <> 0 then concat('No ', event_id, ', ', event_type) end as full_address",
            "ts as created_at", "event_id % 11 = 0 as is_default")

    def categories(self) -> DataFrame:
        names = self.raw("part").select("p_type").distinct()
        return names.selectExpr(f"{CATEGORY_KEY} as categories_id", "p_type as categories_name", "1 as cat_sts")

    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as product_id", "p_name as title", "p_type as category", f"{CATEGORY_KEY} as categories_id",
            "concat(p_brand, ' ', p_name) as description", "p_size % 6 as unit", f"{PRICE} as price",
            f"cast({PRICE} + p_size % 5 * 10 as decimal(10,2)) as mrp",
            "cast(p_size % 4 * 5 as decimal(5,2)) as discount_per", "p_size % 2 as discount_sts",
            "p_size * 10 as lowstqty", "case when p_partkey % 7 <> 0 then p_size * 2 end as openbalqty",
            "case p_partkey % 3 when 1 then date '1997-01-01' when 2 then date '1999-01-01' end as openbaldate",
            "if(p_partkey % 10 = 0, 0, 1) as itmsts",
            "case p_size % 3 when 0 then 'vegitable' when 1 then 'fruit' end as itm_spctyp",
            "concat('thumb/', p_partkey, '.png') as thumbnail")

    def units(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "r_regionkey as unitid", "substring(r_name, 1, 4) as unitshortcode", "r_name as unitname")

    def images(self) -> DataFrame:
        return (
            self.raw("part").where("p_size % 3 > 0")
            .selectExpr("p_partkey as product_id", "explode(sequence(1, p_size % 3)) as copy_no")
            .selectExpr("product_id", "concat('img/', product_id, '-', copy_no, '.png') as image_url")
        )

    def orders(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as order_id", "concat('ORD', lpad(cast(o_orderkey as string), 10, '0')) as order_no",
            "o_custkey as user_id", "cast(o_totalprice as decimal(12,2)) as total_amount",
            "cast(if(o_orderkey % 3 = 0, 20, 0) as decimal(10,2)) as handling_fee",
            "cast(case when o_orderkey % 4 <> 0 then 40 end as decimal(10,2)) as delivery_fee",
            "cast(case when o_orderkey % 10 = 0 then 75 end as decimal(10,2)) as coupon_discount",
            "case o_orderkey % 10 when 0 then concat('SAVE', o_orderkey % 90) when 1 then '' end as coupon_code",
            "case when o_orderpriority = '5-LOW' then 'cancelled' when o_orderstatus = 'F' then 'delivered'"
            " when o_orderstatus = 'P' then 'out_for_delivery' else 'Pending' end as order_status",
            "case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'complete' else 'pending' end"
            " as payment_status",
            "cast(o_orderkey % 5 as int) as delivery_id", "concat('Lane ', o_custkey) as address_delivery",
            "o_orderdate as created_at", "o_orderdate + interval 10 hours as delivery_start",
            "o_orderdate + interval 11 hours as delivery_end")

    def order_items(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey as order_id", "l_partkey as product_id", "l_linenumber as line_no",
            "concat('Item ', l_partkey) as product_name", "cast(l_partkey % 6 as int) as product_unit",
            "cast(l_quantity as int) as product_qty",
            "cast(floor(l_extendedprice / l_quantity) as decimal(12,2)) as product_rate",
            "cast(l_extendedprice as decimal(12,2)) as product_amount", "l_suppkey as supplier_id")

    def payments(self) -> DataFrame:
        return self.raw("orders").where("o_orderkey % 4 <> 0").selectExpr(
            "o_orderkey as order_id", "case o_orderkey % 3 when 0 then 'COD' when 1 then 'UPI' else 'Card' end as method",
            "if(o_orderkey % 3 = 0, 'PENDING', 'complete') as status", "o_orderdate as created_at")

    def tracking(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as id", "user_id as order_id", "upper(event_type) as status", "ts as created_at")

    def cart(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as cart_id", "user_id", "event_id % 3000 as product_id",
            "cast(floor(value) as int) + 1 as quantity", "if(event_type = 'error', 'removed', 'active') as status",
            "ts as created_at")

    def favourites(self) -> DataFrame:
        bought = self.raw("events").where("event_type = 'purchase'")
        return bought.selectExpr("user_id", "event_id % 3000 as product_id", "event_id").groupBy(
            "user_id", "product_id").agg(F.min("event_id").alias("fav_id"))

    def delivery_modes(self) -> DataFrame:
        # The four delivery modes a new store starts with.
        return self.spark.sql(
            "select * from values (1, 'Cash on Delivery'), (2, 'Online Payment'),"
            " (3, 'Card / Swipe'), (4, 'UPI Payment') as t(delivery_id, delivery_mode)"
        )

    def coupons(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey as coupon_id", "concat('SAVE', s_suppkey) as coupon_code",
            "if(s_suppkey % 2 = 0, 'PERCENT', 'FLAT') as discount_type",
            "cast(s_suppkey % 40 + 5 as decimal(10,2)) as discount_value",
            "cast(s_suppkey % 5 * 50000 as decimal(10,2)) as min_order_value",
            "cast(case when s_suppkey % 3 <> 0 then (s_suppkey % 7 + 1) * 1000 end as decimal(10,2)) as max_discount",
            "case when s_suppkey % 4 <> 0 then date_add(date '1999-01-01', cast(s_suppkey % 1500 as int)) end"
            " as expiry_date",
            "s_suppkey % 10 <> 3 as is_active")

    def coupon_usage(self) -> DataFrame:
        used = self.raw("orders").where("o_orderkey % 10 = 0")
        return used.selectExpr("o_orderkey % 90 as coupon_id", "o_custkey as user_id", "o_orderkey").groupBy(
            "coupon_id", "user_id").agg(F.min("o_orderkey").alias("order_id"))

    def partners(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey as driver_id", "s_name as full_name",
            "concat('7', lpad(cast(s_suppkey as string), 9, '0')) as mobile", "if(s_suppkey % 9 = 0, 0, 1) as status",
            "s_nationkey as register_id",
            "case when s_suppkey % 8 <> 0 then date_add(date '2000-01-01', cast(s_suppkey % 365 as int)) end"
            " as created_at")

    def reviews(self) -> DataFrame:
        return self.raw("labels").selectExpr(
            "doc_id as user_id", "1 + quality * 3 + toxic as rating",
            "array_compact(array(if(quality = 1, 'fresh', null), if(toxic = 1, 'rude', null),"
            " if(doc_id % 3 = 0, 'late', null))) as tags")

    def ledger(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_suppkey as purchase_id", "l_orderkey as orderid", "l_partkey as itmid", "l_linenumber as line_no",
            "cast(l_shipdate as date) as purchase_date", f"if({INWARD}, 1, 0) as instoreid",
            f"if({INWARD}, 0, 2) as outstoreid", "cast(l_partkey % 6 as int) as unitid",
            "cast(l_quantity as int) as stockqty", "cast(l_extendedprice as decimal(12,2)) as value",
            "case when l_linenumber = 7 then 1 when l_linenumber <> 6 then 0 end as itmcandel",
            "if(l_discount >= 0.09D, 1, 0) as canordersts")

    def purchases(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey as purchaseid", "s_name as purchase_no",
            "case when s_suppkey % 4 <> 0 then concat('REF-', s_suppkey) end as refrence",
            "date_add(date '1997-01-01', cast(s_suppkey % 700 as int)) as purchasedate",
            "if(s_suppkey % 9 = 0, 1, 0) as cansts", "s_nationkey as storeid")

    def flash_sales(self) -> DataFrame:
        opens = "cast(date_add(date '1998-01-01', cast(s_suppkey % 1000 as int)) as timestamp_ntz)"
        return self.raw("supplier").selectExpr(
            "s_suppkey as flsh_trnid", "s_nationkey as register_id", f"{opens} as from_datetime",
            f"{opens} + interval 400 days as to_datetime")

    def flash_sale_lines(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey % 113 as flsh_trnid", "p_partkey as product_id",
            f"cast({PRICE} - p_size % 9 as decimal(10,2)) as product_rate")

    def item_sheet(self) -> DataFrame:
        """Parts relabelled as an item sheet, with padded, repeated and missing texts."""
        return self.raw("part").selectExpr(
            "p_partkey as trnid",
            "case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then concat('  ', p_name, ' ', p_brand, ' ')"
            " when p_partkey % 12 <> 6 then concat(p_name, ' ', p_brand) end as title",
            "case when p_size % 7 = 0 then concat(' ', p_type, ' ') when p_size % 11 = 0 then concat('NEW ', p_brand)"
            " when p_size % 13 <> 0 then p_type end as categoriesname",
            "case when p_partkey % 5 <> 0 then p_brand end as description",
            f"case when p_partkey % 6 <> 0 then {PRICE} end as price",
            f"case when p_partkey % 8 <> 0 then {PRICE} end as mrp",
            "case when p_partkey % 9 <> 0 then p_size end as quantity",
            "case p_size % 6 when 0 then 'AFRI ' when 1 then 'ASIA' when 3 then 'BOX' when 4 then 'EURO'"
            " when 5 then 'CRATE ' end as unit")

    def tables(self) -> Tables:
        return Tables(**{name: getattr(self, name) for name in TABLE_NAMES})


def bind(spark: SparkSession, folder: str) -> Tables:
    """Logical tables over a folder of the supplied Parquet files."""
    return StarSchema(spark, folder).tables()

"""One submitted order as rows for all the tables it touches, out of one reading and into one commit."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.readers import ORDER_DOCUMENT

# The store that sold goods leave from, and the first tracking row.
SALES_STORE = 2
FIRST_STATUS, FIRST_MESSAGE = "pending", "Order placed successfully"

OUTPUTS = ("orders", "order_items", "ledger", "payments", "tracking", "coupon_usage")
# Tasks that the orders of one coupon are dealt to.
COUPON_SHARES = 32
KEPT_IN_ORDERS = (
    "order_id", "user_id", "address_delivery", "total_amount", "order_status", "payment_status", "delivery_id",
    "delivery_start", "coupon_code")


def _rows_of(name: str, today: dt.date) -> Column:
    """The row of one table out of a header, a line and a coupon."""
    line, zero = F.col("_line"), F.lit(0).cast("decimal(12,2)")
    if name == "orders":
        return F.struct(*KEPT_IN_ORDERS)
    if name == "payments":
        return F.struct(
            "order_id", F.col("payment_method").alias("method"),
            F.when(F.col("payment_method") == "COD", "PENDING").otherwise("complete").alias("status"),
            F.nullif("transaction_id", F.lit("")).alias("transaction_id"))
    if name == "tracking":
        return F.struct("order_id", F.lit(FIRST_STATUS).alias("status"), F.lit(FIRST_MESSAGE).alias("message"))
    if name == "coupon_usage":
        return F.struct(F.col("_coupon").alias("coupon_id"), "user_id", "order_id")
    if name == "order_items":
        return F.struct(
            "order_id",
            *[line[c].alias(c) for c in ("product_id", "product_name", "product_unit", "product_qty", "product_rate", "product_amount")],
            *[F.coalesce(line[c], zero).alias(c) for c in ("discount_amt", "discount_per")])
    return F.struct(
        F.lit(0).alias("purchase_id"), F.lit(today).alias("purchase_date"), F.col("order_id").alias("orderid"),
        F.lit(0).alias("instoreid"), F.lit(SALES_STORE).alias("outstoreid"), line["product_id"].alias("itmid"),
        line["product_name"].alias("itmname"), line["product_unit"].alias("unitid"), line["product_qty"].alias("stockqty"),
        line["product_rate"].alias("rate"), line["product_amount"].alias("value"), line["product_qty"].alias("currentstock"),
        F.lit(0).alias("itmcandel"), F.lit(0).alias("canordersts"))


def tagged_fanout(documents: DataFrame, coupons: DataFrame, today: dt.date, outputs: Sequence[str] = OUTPUTS,
                  column: str = "document") -> DataFrame:
    """(output, and a column for each of the outputs): every row of every table, in the column of the table it is for.

    Each document is read once and makes all its rows: its lines are laid out, the header standing with the first of
    them, and each of these rows is repeated for every table it has a row in. A long order may come in several
    documents numbered by ``part_no``; the first one (0 or no number) gives the header. What is no document, or has no
    order id, makes no rows.
    """
    rows = documents.select(F.from_json(column, ORDER_DOCUMENT).alias("_d")).select("_d.*")
    first = F.col("order_id").isNotNull() & (F.coalesce("part_no", F.lit(0)) == 0)
    used = "coupon_usage" in outputs
    if used:
        known = coupons.groupBy(F.col("coupon_code").alias("_code")).agg(F.collect_list("coupon_id").alias("_coupons"))
        # Coupons are few, so each is repeated for all shares of the orders that enter it; counting which ones are
        # entered most would read the documents twice. Orders without a coupon get codes of their own.
        place = F.xxhash64("order_id", "part_no")
        code = F.coalesce(F.when(first, F.nullif("coupon_code", F.lit(""))), F.concat(F.lit("\u0000"), place.cast("string")))
        rows = rows.withColumns({"_code": code, "_share": F.pmod(place, F.lit(COUPON_SHARES))}).join(
            known.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COUPON_SHARES - 1).cast("long")))),
            ["_code", "_share"], "left")
    kept = [c for c in rows.columns if c not in ("items_details", "part_no", "_code", "_share")]
    laid = rows.select(*kept, first.alias("_header"), F.posexplode_outer("items_details").alias("_no", "_line"))
    coupon = F.col("_coupons") if used else F.array()
    coupon_kind = coupons.schema["coupon_id"].dataType
    part = lambda name: F.struct(F.lit(name).alias("output"), F.lit(None).cast(coupon_kind).alias("_coupon"))
    of_header = [part(n) for n in outputs if n in ("orders", "payments", "tracking")]
    of_line = [part(n) for n in outputs if n in ("order_items", "ledger")]
    nothing = F.array().cast(f"array<struct<output: string, _coupon: {coupon_kind.simpleString()}>>")
    parts = []
    if of_header:
        parts.append(F.when(F.col("_header") & (F.coalesce("_no", F.lit(0)) == 0), F.array(*of_header)).otherwise(nothing))
    if of_line:
        parts.append(F.when(F.col("_no").isNotNull() & F.col("order_id").isNotNull(), F.array(*of_line)).otherwise(nothing))
    if used:
        parts.append(F.when(F.col("_header") & (F.coalesce("_no", F.lit(0)) == 0) & F.col("_coupons").isNotNull(), F.transform(
            coupon, lambda c: F.struct(F.lit("coupon_usage").alias("output"), c.alias("_coupon")))).otherwise(nothing))
    every = laid.select(*[c for c in laid.columns if c != "_coupons"], F.inline(F.concat(*parts)))
    return every.select("output", *[F.when(F.col("output") == n, _rows_of(n, today)).alias(n) for n in outputs])


def order_fanout(documents: DataFrame, coupons: DataFrame, today: dt.date) -> dict[str, DataFrame]:
    """Rows for orders, items, stock ledger, payment, tracking and coupon usage, each table by itself."""
    return {name: fanout_of(name, documents, coupons, today) for name in OUTPUTS}


def fanout_of(name: str, documents: DataFrame, coupons: DataFrame, today: dt.date) -> DataFrame:
    """The rows of one of the tables."""
    return tagged_fanout(documents, coupons, today, [name]).select(f"{name}.*")


# --- one write for all tables ---
#
# Rows of a batch go to one folder, parted by table, in one job. The batch counts once a file with its number and its
# attempt stands in ``done``; until then readers see the attempt before, whole, or nothing of the batch.


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _finished(spark: SparkSession, folder: str) -> dict[int, tuple[int, str]]:
    """(attempt, folder name) that counts, for each batch."""
    fs, at = _files(spark, f"{folder}/done")
    found: dict[int, tuple[int, str]] = {}
    for f in fs.listStatus(at) if fs.exists(at) else []:
        batch, attempt, name = f.getPath().getName().split("_")
        found[int(batch)] = max(found.get(int(batch), (-1, "")), (int(attempt), name))
    return found


def write_fanout(tagged: DataFrame, folder: str, batch: int) -> None:
    """Write the rows of all tables in one job. A batch that is written again replaces all its tables at once."""
    spark = tagged.sparkSession
    before = _finished(spark, folder).get(batch, (-1, ""))
    name = uuid.uuid4().hex
    tagged.write.partitionBy("output").parquet(f"{folder}/rows/part={name}")
    fs, done = _files(spark, f"{folder}/done/{batch}_{before[0] + 1}_{name}")
    fs.create(done, True).close()
    if before[1]:
        for old in (f"{folder}/done/{batch}_{before[0]}_{before[1]}", f"{folder}/rows/part={before[1]}"):
            fs.delete(_files(spark, old)[1], True)


def read_fanout(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The tagged rows of all batches written so far (``schema`` is that of ``tagged_fanout``). A condition on
    ``output`` reads the files of that table alone."""
    parts = sorted(f"{folder}/rows/part={name}" for _, name in _finished(spark, folder).values())
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(*parts).select(*schema.names)

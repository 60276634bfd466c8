"""Per-key shapes that keep working when one key holds much of the table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Rows of one key that one task may take; the session setting ``storelens.hotKeyRows`` overrides it.
HOT_KEY_ROWS = 2_000_000
# Rows of one key that one task may hold as a list; ``storelens.documentRows`` overrides it.
DOCUMENT_KEY_ROWS = 100_000


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def newest_first(column: str | Column) -> list[Column]:
    """Order parts under which a missing value counts as the newest one."""
    col = F.col(column) if isinstance(column, str) else column
    return [col.isNull(), col]


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
           columns: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one whose order parts are greatest.

    An aggregate rather than a window: each task keeps one row per key, so a
    key with very many rows reaches the shuffle as one row per task.
    """
    row = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more rows than one task should take, and in how many shares to cut them.

    Counted within the query, from the key columns alone: building a plan starts no job, and the counts are those of
    the rows that the query reads. All tasks get the result, which has at most one row for ``storelens.hotKeyRows``
    rows of the table. Where it is empty, adaptive execution takes the steps that depend on it out of the plan.
    """
    limit = _setting(df, "storelens.hotKeyRows", HOT_KEY_ROWS)
    return F.broadcast(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).alias("_shares"))
    )


def with_shares(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``_shares``, NULL unless their key is hot; a missing key is a key like any other."""
    marks = hot.withColumnsRenamed({key: f"_hot_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys]
    return df.join(marks, same, "left").drop(*[f"_hot_{key}" for key in keys])


def spread_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], by: Sequence[str],
                how: str = "left", base: DataFrame | None = None, hot_on: Sequence[str] | None = None) -> DataFrame:
    """Join where a key may hold much of ``df``: its rows are cut into shares.

    The shares of a hot key go to different tasks by the columns ``by``, and
    its lookup rows are repeated once per share. Other keys join as they are.
    AQE does not cut such a key where the lookup is itself grouped by it.
    ``base`` is a table whose keys are counted in place of those of ``df``,
    which must not have a key more often; it saves what ``df`` is made with.
    Of several keys, those in ``hot_on`` tell what is hot.
    """
    hot_on = hot_on or keys
    hot = hot_keys(df if base is None else base, hot_on)
    share = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_shares")), F.lit(0).cast("long"))
    left = with_shares(df, hot, hot_on).withColumn("_share", share).drop("_shares")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_shares"), F.lit(1).cast("long")) - 1)
    right = with_shares(lookup, hot, hot_on).withColumn("_share", F.explode(copies)).drop("_shares")
    return left.join(right, [*keys, "_share"], how).drop("_share")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Mapping[str, Column],
           name: str = "position", all_hot: bool = False) -> DataFrame:
    """Number the rows of each key from 1, without one task seeing a whole hot key.

    ``bucket`` cuts the order into stretches: its columns are never NULL and,
    read in turn, rise with ``order``. Rows of a hot key are numbered inside
    their stretch and the lengths of the earlier stretches are added; other
    keys are one stretch. Without ``by`` the whole table is one key, and
    with ``all_hot`` every key is taken for a hot one.
    """
    keys = [*by, *bucket]
    if by and not all_hot:
        marked = with_shares(df, hot_keys(df, by), by)
        hot = F.col("_shares").isNotNull()
        marked = marked.withColumns({b: F.when(hot, c) for b, c in bucket.items()})
        split, marked = marked.where(hot), marked.drop("_shares")
    else:
        split = marked = df.withColumns(dict(bucket))
    lengths = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    starts = _starts(lengths, list(by), list(bucket))
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return (
        marked.withColumn("_inside", inside)
        .join(starts.withColumnsRenamed({k: f"_of_{k}" for k in keys}), same, "left")
        .withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_inside"))
        .drop("_inside", "_start", *bucket, *[f"_of_{k}" for k in keys])
    )


# Bits of a whole-number stretch that are added up at once: a window holds at most so many stretches of a key.
LEVEL_BITS = 24


def _starts(lengths: DataFrame, by: list[str], bucket: list[str]) -> DataFrame:
    """Rows before each stretch of its key.

    Added up level by level, whole-number stretches in two levels of ``LEVEL_BITS``, so that windows stay small however
    the stretches are spread.
    """
    levels = []
    rows = lengths
    for b in bucket:
        if isinstance(lengths.schema[b].dataType, T.IntegralType):
            rows = rows.withColumn(f"_high_{b}", F.shiftright(F.col(b).cast("long"), LEVEL_BITS))
            levels.append(f"_high_{b}")
        levels.append(b)
    earlier = lambda path, level: F.coalesce(F.sum("_rows").over(
        W.partitionBy(*path).orderBy(level).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    path, out = list(by), rows.withColumn("_start", F.lit(0).cast("long"))
    for level in levels[:-1]:
        sums = rows.groupBy(*path, level).agg(F.sum("_rows").alias("_rows"))
        before = sums.select(*[F.col(c).alias(f"_at_{c}") for c in [*path, level]], earlier(path, level).alias("_before"))
        path.append(level)
        out = out.join(before, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in path]).withColumn(
            "_start", F.col("_start") + F.col("_before")).drop("_before", *[f"_at_{c}" for c in path])
    return out.withColumn("_start", F.col("_start") + earlier(path, levels[-1])).select(*by, *bucket, "_start")


def minute_of(column: str) -> Column:
    """Whole minutes of a time column, a fine enough stretch for a key that is busy all the time."""
    # Read off the calendar fields, so that it rises with the column in any session time zone.
    return F.unix_date(F.to_date(column)).cast("long") * 1440 + F.hour(column) * 60 + F.minute(column)


def moment_of(column: str) -> Column:
    """A time column as whole microseconds, a stretch that only equal times share."""
    return minute_of(column) * 60_000_000 + F.floor(F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")


def stretch(column: str | Column, bits: int = 16) -> Column:
    """Stretch of a whole-number column: at most ``2 ** bits`` distinct values each."""
    col = F.col(column) if isinstance(column, str) else column
    return F.shiftright(col.cast("long"), bits)


def documents(headers: DataFrame, rows: DataFrame, key: str, order: Sequence[str], bucket: Mapping[str, Column],
              item: Callable[[Column, Column], Column], page_rows: int, name: str) -> DataFrame:
    """Headers with the list of their rows, in pages of at most ``page_rows`` told apart by ``page_no``.

    ``item`` makes a list entry out of a row and its place. The rows of a key
    are grouped, sorted and cut into pages together with its header, in one
    shuffle. Keys with more than ``documentRows`` rows are numbered by
    stretches instead (see ``ranked``), so no list grows with the table. A
    header without rows is one page with no list.
    """
    limit = _setting(rows, "storelens.documentRows", DOCUMENT_KEY_ROWS)
    # At most one row for ``limit`` rows of the table; where it is empty, adaptive execution drops the second way.
    long_keys = F.broadcast(
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") > limit) & F.col(key).isNotNull()).select(key)
    )
    columns = [*order, *[c for c in rows.columns if c != key and c not in order]]

    def shorter(df: DataFrame) -> DataFrame:
        return df.join(long_keys, key, "left_anti")

    lists = (
        shorter(rows).groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))
    )
    last = F.floor((F.coalesce(F.size("_rows"), F.lit(1)) - 1) / page_rows).cast("int")
    start = F.col("page_no") * page_rows
    short = (
        shorter(headers).join(lists, key, "left")
        .withColumn("page_no", F.explode(F.sequence(F.lit(0), last)))
        .withColumn(name, F.transform(F.slice("_rows", start + 1, page_rows),
                                      lambda row, i: item(row, (start + i + 1).cast("long"))))
        .drop("_rows")
    )

    # The same full order as in the lists, so that ties stand alike on both ways.
    numbered = ranked(rows.join(long_keys, key, "left_semi"), [key], [F.col(c) for c in columns], bucket, "_at", all_hot=True)
    entry = F.struct("_at", item(F.struct(*columns), F.col("_at").cast("long")).alias("_item"))
    page_no = F.floor((F.col("_at") - 1) / page_rows).cast("int").alias("page_no")
    long = (
        numbered.groupBy(key, page_no).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
        .withColumn(name, F.transform("_rows", lambda row: row["_item"])).drop("_rows")
        .join(headers.join(long_keys, key, "left_semi"), key)
    )
    return short.unionByName(long)


# Largest page that is sent to all tasks; a larger one is joined like any table.
PAGE_ROWS = 10_000


def only_shown(df: DataFrame, shown: DataFrame, key: str, size: int | None) -> DataFrame:
    """Rows whose key stands on a page of at most ``size`` rows; all rows without a page."""
    if size is None:
        return df
    keys = shown.select(key)
    return df.join(F.broadcast(keys) if size <= PAGE_ROWS else keys, key, "left_semi")


@dataclass(frozen=True)
class By:
    """One column of a listing's order. Missing values come first in a falling order and last in a rising one,
    unless told otherwise."""

    column: str
    falling: bool = False
    missing_first: bool | None = None

    @property
    def first(self) -> bool:
        return self.falling if self.missing_first is None else self.missing_first

    def order(self) -> Column:
        col = F.col(self.column)
        if self.falling:
            return col.desc_nulls_first() if self.first else col.desc_nulls_last()
        return col.asc_nulls_first() if self.first else col.asc_nulls_last()

    def same(self, value: Column | None) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == value

    def later(self, value: Column | None) -> Column:
        """Rows that come after those with this value."""
        col = F.col(self.column)
        if value is None:
            return col.isNotNull() if self.first else F.lit(False)
        beyond = col < value if self.falling else col > value
        return beyond if self.first else beyond | col.isNull()


def cursor(rows: DataFrame, order: Sequence[By]) -> tuple | None:
    """Where a listing goes on after a row: its values in the order's columns. Of several rows the last one counts;
    None if there is none."""
    last = rows.select(*[b.column for b in order]).orderBy(*[b.order() for b in order]).tail(1)
    return tuple(last[0]) if last else None


def beyond(df: DataFrame, order: Sequence[By], after: Sequence) -> Column:
    """Condition for the rows that come after a cursor.

    Values are literals of the column's own type, and the range of the first
    column stands beside the full condition, so that both reach the scan.
    """
    if len(after) != len(order):
        raise ValueError(f"a cursor of {len(order)} values is needed, not of {len(after)}")
    values = [None if v is None else F.lit(v if isinstance(v, str) else str(v)).cast(df.schema[b.column].dataType)
              for b, v in zip(order, after, strict=True)]
    found = None
    for b, v in reversed(list(zip(order, values, strict=True))):
        found = b.later(v) if found is None else b.later(v) | (b.same(v) & found)
    return (order[0].later(values[0]) | order[0].same(values[0])) & found


def page(df: DataFrame, order: Sequence[By], number: int = 1, size: int | None = None,
         after: Sequence | None = None) -> DataFrame:
    """One page of a sorted listing; the whole relation, unsorted, if no size is given.

    ``after`` is the cursor of the last row seen, for pages far into a listing: rows up to it are left out where they
    are read, while an offset would sort and carry them all.
    """
    if after is not None:
        if number > 1:
            raise ValueError("a page is told by its number or by the row before it")
        df = df.where(beyond(df, order, after))
    if size is None:
        return df
    listing = df.orderBy(*[b.order() for b in order])
    if number > 1:
        listing = listing.offset((number - 1) * size)
    return listing.limit(size)

"""Cart lines kept up to date by a stream of numbered actions, without keeping the actions.

Actions are applied in the order of their number ``seq``, which says where a late one belongs. The numbers are given out
one after the other, so what is still missing shows as a gap: once every number below some point has arrived, nothing
can come in between any more. Everything below that point is folded into cart lines and dropped; only actions above it
wait as they are. The point moves in stretches of ``2 ** bits`` numbers, each of which is counted.

Lines are written anew only when the actions to fold are at least one in ``SHARE`` of them, so an action is written a
bounded number of times however long the stream runs, and a reader meets the lines and at most a share of them in
waiting actions. Each micro-batch writes its actions to a folder of its own; folded states lie beside them, marked by an
empty file that is made last. A batch that runs again starts from the state before it and replaces what it wrote.

Rows whose number stands for something else than a cart action have no ``op``; they close gaps and do nothing. A number
below the point, or one that waits already, is a second delivery of the same action and changes nothing. Numbers start at 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storelens.operators.changes import cart_merge
from storelens.streaming.feeds import NOW, batch_numbers, folder_of, read_batches

ACTIONS = "seq bigint, user_id bigint, product_id bigint, op string, qty bigint"
LINES = "user_id bigint, product_id bigint, quantity bigint, status string"
# Numbers counted as one: the point moves by 1,024 of them.
STRETCH_BITS = 10
# Lines are written anew when at least one in so many of them can be folded in.
SHARE = 8


@dataclass(frozen=True)
class State:
    """A folded state: the batch that wrote it, the point below which all is folded, and its number of lines."""

    batch: int
    upto: int
    lines: int


def _states(spark: SparkSession, target: str) -> list[State]:
    """Finished states, oldest first. What a state is stands in the name of the file that marks it."""
    fs, at = folder_of(spark, f"{target}/done")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((State(*map(int, name.split("_")[1:])) for name in names if name.startswith("state_")), key=lambda s: s.batch)


def _latest(spark: SparkSession, target: str, before: int | None = None) -> State:
    found = [s for s in _states(spark, target) if before is None or s.batch < before]
    return found[-1] if found else State(-1, 0, 0)


def _mark(spark: SparkSession, target: str, state: State) -> None:
    fs, at = folder_of(spark, f"{target}/done/state_{state.batch}_{state.upto}_{state.lines}")
    fs.create(at, True).close()


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = folder_of(spark, path)
    fs.delete(at, True)


def lines_of(spark: SparkSession, target: str, state: State) -> DataFrame:
    """The folded lines of a state."""
    if state.batch < 0:
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).parquet(f"{target}/state/batch={state.batch}/lines")


def waiting(spark: SparkSession, target: str, state: State, through: int | None = None) -> DataFrame:
    """Actions that no line of a state holds yet, once each."""
    rows = read_batches(spark, target, ACTIONS, state.batch + 1, None if through is None else through + 1)
    if state.batch >= 0:
        rows = rows.unionByName(spark.read.schema(ACTIONS).parquet(f"{target}/state/batch={state.batch}/waiting"))
        rows = rows.where(F.col("seq") >= state.upto)
    return rows.dropDuplicates(["seq"])


def whole_until(actions: DataFrame, upto: int, bits: int) -> int:
    """The number below which no number at or above ``upto`` is missing, in whole stretches."""
    stretch = F.shiftright(F.col("seq"), bits).alias("stretch")
    # Of the stretch that holds ``upto``, what lies below it is no longer there.
    whole = F.when(F.col("stretch") == upto >> bits, ((upto >> bits) + 1 << bits) - upto).otherwise(1 << bits)
    full = actions.groupBy(stretch).count().where(F.col("count") == whole).select("stretch")
    here = actions.sparkSession.createDataFrame([(upto >> bits,)], "stretch bigint")
    ends = full.select((F.col("stretch") + 1).alias("stretch")).union(here)
    return max(upto, ends.join(full, "stretch", "left_anti").agg(F.min("stretch")).first()[0] << bits)


def _promised(spark: SparkSession, target: str) -> int:
    fs, at = folder_of(spark, f"{target}/promised")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return max([int(n) for n in names if n.isdigit()], default=0)


def promise(spark: SparkSession, target: str, upto: int) -> None:
    """State that no number below ``upto`` will come any more, so that numbers that were never given out don't keep
    the actions after them waiting. The next batch acts on it."""
    fs, at = folder_of(spark, f"{target}/promised/{upto}")
    fs.create(at, True).close()


def fold(spark: SparkSession, target: str, batch: int, bits: int | None = None, share: int = SHARE) -> State:
    """Fold what has become whole with a batch, if that is enough to write the lines anew."""
    state = _latest(spark, target, batch)
    actions = waiting(spark, target, state, batch)
    upto = max(whole_until(actions, state.upto, STRETCH_BITS if bits is None else bits), _promised(spark, target))
    if upto - state.upto < max(1, state.lines // share):
        return state
    place = f"{target}/state/batch={batch}"
    closed = actions.where(F.col("seq") < upto)
    cart_merge(lines_of(spark, target, state), closed).write.mode("overwrite").parquet(f"{place}/lines")
    actions.where(F.col("seq") >= upto).write.mode("overwrite").parquet(f"{place}/waiting")
    now = State(batch, upto, spark.read.schema(LINES).parquet(f"{place}/lines").count())
    _mark(spark, target, now)
    # The state before stays for a batch that runs again; what it was made from goes.
    for old in [s for s in _states(spark, target) if s.batch < state.batch]:
        _drop(spark, f"{target}/done/state_{old.batch}_{old.upto}_{old.lines}")
        _drop(spark, f"{target}/state/batch={old.batch}")
    for old in [b for b in batch_numbers(spark, target) if b <= state.batch]:
        _drop(spark, f"{target}/rows/batch={old}")
    return now


def cart_stream(actions: DataFrame, target: str, trigger: dict | None = None, bits: int | None = None,
                share: int = SHARE) -> StreamingQuery:
    """Keep the carts of a stream of actions (seq, user_id, product_id, op, qty) in a folder."""
    spark = actions.sparkSession

    def step(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={batch}")
        fold(spark, target, batch, bits, share)

    return (
        actions.select("seq", "user_id", "product_id", "op", "qty").writeStream.outputMode("append").foreachBatch(step)
        .option("checkpointLocation", f"{target}/checkpoint").trigger(**(trigger or NOW)).start()
    )


def read_cart(spark: SparkSession, target: str, users: DataFrame | None = None) -> DataFrame:
    """Cart lines after all actions that have arrived, or those of some users (``user_id``)."""
    state = _latest(spark, target)
    lines, actions = lines_of(spark, target, state), waiting(spark, target, state)
    if users is not None:
        chosen = users.select("user_id").distinct()
        lines, actions = (rows.join(chosen, "user_id", "left_semi") for rows in (lines, actions))
    return cart_merge(lines, actions)

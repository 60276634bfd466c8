"""The cart stream against step-by-step Python: late actions, gaps, repeated batches and a bounded history."""

import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows
from tests.test_folds import ACTIONS, random_case, step_by_step

from storelens.streaming import carts, feeds

COLUMNS = ("user_id", "product_id", "quantity", "status")


def feed(spark, folder, target, batches, **how):
    """Run the stream once for each batch of actions, each a file of its own."""
    for batch in batches:
        spark.createDataFrame(batch, ACTIONS).coalesce(1).write.mode("append").parquet(folder)
        carts.cart_stream(spark.readStream.schema(ACTIONS).parquet(folder), target, **how).awaitTermination()


def dealt(actions, seed, n, reach):
    """Actions in batches, each up to ``reach`` places from where it belongs."""
    draw = random.Random(seed)
    order = sorted(actions, key=lambda a: a[0] + draw.uniform(0, reach))
    size = -(-len(order) // n)
    return [order[i : i + size] for i in range(0, len(order), size)]


def kept(spark, target):
    """(actions that are kept as they are, all rows that a reader meets)."""
    state = carts._latest(spark, target)
    actions = carts.waiting(spark, target, state).count()
    return actions, actions + state.lines


@pytest.mark.parametrize(("seed", "reach", "share"), [(1, 400, 8), (3, 60, 1)])
def test_six_batches_in_no_order(spark, tmp_path, seed, reach, share):
    _, actions = random_case(seed, 1)
    target = str(tmp_path / "out")
    feed(spark, str(tmp_path / "in"), target, dealt(actions, seed, 6, reach), bits=3, share=share)
    assert rows(carts.read_cart(spark, target), *COLUMNS) == step_by_step([], actions)
    some = carts.read_cart(spark, target, spark.createDataFrame([(1,)], "user_id long"))
    assert rows(some, *COLUMNS) == [r for r in step_by_step([], actions) if r[0] == 1]
    # 300 numbers: 37 whole stretches of eight, and four left.
    assert carts._latest(spark, target).upto == 296 and kept(spark, target)[0] == 4


def test_history_does_not_grow(spark, tmp_path):
    draw = random.Random(3)
    actions = [(i, draw.randrange(3), draw.randrange(4), "add", 1) for i in range(600)]
    target, folder = str(tmp_path / "out"), str(tmp_path / "in")
    seen = []
    for batch in dealt(actions, 3, 6, 25):
        feed(spark, folder, target, [batch], bits=3)
        seen.append(kept(spark, target)[1])
        # What lies in the folder is that of the last two states and of the batches after the older one.
        states = [s.batch for s in carts._states(spark, target)]
        assert len(states) <= 2 and all(b > states[0] or len(states) == 1 for b in feeds.batch_numbers(spark, target))
    assert max(seen) <= 12 + 25 + 8 + 100 and seen[-1] <= 12 + 8
    assert sum(r[2] for r in rows(carts.read_cart(spark, target), *COLUMNS)) == 600


def test_a_gap_keeps_what_follows_waiting(spark, tmp_path):
    _, actions = random_case(7, 1)
    target, folder = str(tmp_path / "out"), str(tmp_path / "in")
    missing = [a for a in actions if a[0] in (40, 41, 200)]
    rest = [a for a in actions if a[0] not in (40, 41, 200)]
    feed(spark, folder, target, dealt(rest, 7, 3, 30), bits=3)
    assert carts._latest(spark, target).upto == 40 and kept(spark, target)[0] == 257
    assert rows(carts.read_cart(spark, target), *COLUMNS) == step_by_step([], rest)
    feed(spark, folder, target, [missing[:2]], bits=3)
    assert carts._latest(spark, target).upto == 200
    # Number 200 was never given out.
    carts.promise(spark, target, 208)
    feed(spark, folder, target, [[(300, 1, 1, "add", 1)]], bits=3)
    assert carts._latest(spark, target).upto == 208
    feed(spark, folder, target, [[(301, 1, 1, "add", 1)]], bits=3)
    assert carts._latest(spark, target).upto == 296
    every = [a for a in actions if a[0] != 200] + [(300, 1, 1, "add", 1), (301, 1, 1, "add", 1)]
    assert rows(carts.read_cart(spark, target), *COLUMNS) == step_by_step([], every)


def test_second_deliveries_and_numbers_of_other_things(spark, tmp_path):
    _, actions = random_case(9, 1)
    others = [(i, None, None, None, None) for i in range(300, 330)]
    target = str(tmp_path / "out")
    twice = [actions[:150], actions[100:] + others, actions[:300] + others[3:]]
    feed(spark, str(tmp_path / "in"), target, twice, bits=3)
    assert carts._latest(spark, target).upto == 328
    assert rows(carts.read_cart(spark, target), *COLUMNS) == step_by_step([], actions)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    _, actions = random_case(11, 1)
    target = str(tmp_path / "out")
    write = lambda batch, some: spark.createDataFrame(some, ACTIONS).write.mode("overwrite").parquet(
        f"{target}/rows/batch={batch}")
    for batch in range(3):
        write(batch, actions[batch * 100 : batch * 100 + 100])
        carts.fold(spark, target, batch, bits=3)
    want = step_by_step([], actions)
    assert rows(carts.read_cart(spark, target), *COLUMNS) == want
    # The last batch once more, and once more without the mark of its state, as after a crash in its midst.
    carts.fold(spark, target, 2, bits=3)
    assert rows(carts.read_cart(spark, target), *COLUMNS) == want
    last = carts._latest(spark, target)
    carts._drop(spark, f"{target}/done/state_{last.batch}_{last.upto}_{last.lines}")
    assert rows(carts.read_cart(spark, target), *COLUMNS) == want
    carts.fold(spark, target, 2, bits=3)
    assert carts._latest(spark, target) == last and rows(carts.read_cart(spark, target), *COLUMNS) == want


def test_whole_stretches(spark):
    until = lambda numbers, upto=0: carts.whole_until(spark.createDataFrame([(n,) for n in numbers], "seq long"), upto, 2)
    assert until([]) == 0 and until([], 8) == 8 and until(range(8)) == 8 and until(range(1, 8)) == 0
    assert until(range(6, 12), 6) == 12 and until([7, 8, 9, 10, 11], 6) == 6
    assert until([*range(8), *range(12, 20)]) == 8 and until([*range(8, 12), *range(16, 20)], 8) == 12


def test_cart_of_no_actions(spark, tmp_path):
    assert carts.read_cart(spark, str(tmp_path / "none")).collect() == []
    _, actions = random_case(13, 1)
    empty = spark.createDataFrame(actions, ACTIONS).where(F.lit(False))
    empty.write.parquet(str(tmp_path / "in"))
    carts.cart_stream(spark.readStream.schema(ACTIONS).parquet(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert carts.read_cart(spark, str(tmp_path / "out")).collect() == []

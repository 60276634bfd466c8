"""Operators that follow an order, against step-by-step Python."""

import datetime as dt
import random

import pytest
from tests.conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from storelens.functions.keyed import ranked, spread_join, stretch
from storelens.operators.changes import cart_merge, cart_steps, fold_cart
from storelens.operators.pricing import otp_match

from pyspark.sql import functions as F

ACTIONS = "seq long, user_id long, product_id long, op string, qty long"
CART = "user_id long, product_id long, quantity long, status string"


def step_by_step(cart, actions):
    lines = {(u, p): [q, s == "active"] for u, p, q, s in cart}
    for _, user, product, op, qty in sorted(actions):
        if op == "clear":
            for (u, _), line in lines.items():
                if u == user:
                    line[1] = False
            continue
        line = lines.get((user, product))
        active = line is not None and line[1]
        if op == "add":
            lines[(user, product)] = [line[0] + (qty or 1), True] if active else [qty or 1, True]
        elif op == "reorder":
            lines[(user, product)] = [qty, True]
        elif op == "set" and qty and active:
            line[0] = qty
        elif op == "remove" and line:
            line[1] = False
    return sorted(((u, p, q if on else None, "active" if on else "removed") for (u, p), (q, on) in lines.items()), key=repr)


def random_case(seed, spread):
    rng = random.Random(seed)
    actions = []
    for i in range(300):
        op = rng.choice(["add", "add", "set", "remove", "reorder", "clear"] if rng.random() < 0.5 else ["add", "set", "remove"])
        product = None if op == "clear" else rng.randrange(4)
        qty = rng.choice([None, 0, 1, 2, 5]) if op in ("add", "set") else rng.randrange(1, 9)
        actions.append((i * spread, rng.choice([1, 1, 1, 2, 3]), product, op, qty))
    cart = [(1, 0, 4, "active"), (1, 9, 2, "active"), (2, 1, 3, "removed")]
    return cart, actions


@pytest.mark.parametrize("seed,spread", [(1, 1), (2, 1000), (3, 70000), (4, 1 << 33)])
def test_cart_fold(spark, seed, spread):
    cart, actions = random_case(seed, spread)
    got = cart_merge(spark.createDataFrame(cart, CART), spark.createDataFrame(actions, ACTIONS))
    assert rows(got, "user_id", "product_id", "quantity", "status") == step_by_step(cart, actions)


def test_cart_fold_does_not_depend_on_the_stretch(spark):
    _, actions = random_case(5, 3)
    steps = cart_steps(spark.createDataFrame([a for a in actions if a[3] != "clear"], ACTIONS))
    assert rows(fold_cart(steps, bits=2)) == rows(fold_cart(steps, bits=16))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=60, unique_by=lambda r: r[1]),
       st.integers(0, 6))
def test_ranked_is_row_number(spark, hot_at_five, data, bits):
    df = spark.createDataFrame(data, "k long, n long")
    got = ranked(df, ["k"], [F.col("n")], {"_s": stretch("n", bits)})
    want = []
    for key in {k for k, _ in data}:
        want += [(key, n, i + 1) for i, n in enumerate(sorted(n for k, n in data if k == key))]
    assert rows(got, "k", "n", "position") == sorted(want, key=repr)


@pytest.mark.parametrize("bits", [24, 40])
def test_ranked_splits_equal_times_missing_keys_and_wide_numbers(spark, hot_at_five, monkeypatch, bits):
    """A third of the rows at one time, a third without a time, a third without a key, and numbers far apart."""
    from storelens.functions import keyed
    from storelens.functions.keyed import moment_of

    monkeypatch.setattr(keyed, "LEVEL_BITS", bits)

    rng = random.Random(5)
    data = []
    for n in range(90):
        at = dt.datetime(2024, 1, 1) if n % 3 == 0 else None if n % 3 == 1 else dt.datetime(2024, 1, 2) + dt.timedelta(seconds=rng.randrange(9))
        data.append((None if n % 3 == 2 else 1, at, rng.getrandbits(62) - 2**61))
    df = spark.createDataFrame(data, "k long, at timestamp_ntz, id long")
    order = [F.col("at").asc_nulls_last(), F.col("id")]
    got = ranked(df, ["k"], order, {"_m": F.coalesce(moment_of("at"), F.lit(2**62)), "_s": stretch("id")})
    want = []
    for key in (1, None):
        mine = sorted((at is None, at or dt.datetime.max, i) for k, at, i in data if k == key)
        want += [(key, i, place) for place, (_, _, i) in enumerate(mine, 1)]
    assert rows(got, "k", "id", "position") == sorted(want, key=repr)
    whole = ranked(df, [], [F.col("id")], {"_s": stretch("id")})
    assert [r[0] for r in whole.orderBy("position").select("id").collect()] == sorted(i for *_, i in data)


def test_spread_join_keeps_every_row(spark, hot_at_five):
    big = spark.range(100).select(F.col("id"), F.when(F.col("id") < 80, 1).when(F.col("id") < 90, None)
                                  .otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(1, "a"), (1, "b"), (95, "c"), (7, "d")], "k long, v string")
    for how in ("left", "inner"):
        assert rows(spread_join(big, small, ["k"], ["id"], how), "id", "k", "v") == rows(big.join(small, "k", how), "id", "k", "v")


@pytest.mark.parametrize(("valid", "busy"), [(dt.timedelta(minutes=5), False), (dt.timedelta(hours=3), True), (None, False), (None, True)])
def test_codes(spark, hot_at_five, valid, busy):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    events = []
    for seq in range(400):
        at = start + dt.timedelta(minutes=rng.randrange(0, 2000))
        if busy and seq % 3:
            # Much of the table in one minute, much of that at one moment.
            at = start + dt.timedelta(minutes=900, microseconds=7 if seq % 3 == 1 else rng.randrange(50_000_000))
            seq += 70_000 * rng.randrange(4)
        events.append((rng.choice([1, 1, 1, 2]), at, seq, rng.randrange(2), rng.random() < 0.3))
    schema = "user_id long, at timestamp_ntz, seq long, code long"
    frame = lambda issue: spark.createDataFrame([e[:4] for e in events if e[4] == issue], schema)
    want, last, used = [], {}, set()
    for user, at, seq, code, issue in sorted(events, key=lambda e: (e[1], e[2])):
        if issue:
            last[user] = (at, seq, code)
            continue
        known = last.get(user)
        if known is None:
            outcome = "no_code"
        elif known[2] != code:
            outcome = "wrong_code"
        elif valid is not None and not known[0] + valid > at:
            outcome = "expired"
        elif known[1] in used:
            outcome = "used"
        else:
            outcome = "matched"
            used.add(known[1])
        want.append((seq, outcome))
    assert rows(otp_match(frame(True), frame(False), valid), "seq", "outcome") == sorted(want, key=repr)

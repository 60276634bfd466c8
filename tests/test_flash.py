"""Flash-sale quantities against a plain sum, with times at and around the ends of sales."""

import datetime as dt
import random

from tests.conftest import rows

from storelens.operators.catalogue import flash_sale_orders
from storelens.sources.tables import Tables


def test_as_a_plain_sum(spark):
    draw = random.Random(4)
    begin = dt.datetime(2024, 1, 1)
    tick = dt.timedelta(microseconds=1)
    moment = lambda: begin + dt.timedelta(hours=draw.randrange(0, 24 * 6, 3)) + draw.choice([-1, 0, 0, 1]) * tick
    orders = [(i, None if i % 17 == 0 else moment()) for i in range(400)]
    lines = [(i, draw.choice([1, 1, 1, 2, 3]), draw.randrange(1, 5)) for i in range(400) for _ in range(2)]
    sales = [(s, *(sorted((moment(), moment())) if s % 9 else [begin + tick, begin])) for s in range(40)] + [(90, None, begin)]
    offered = [(s, p) for s in [*range(40), 90, 91] for p in (1, 2, 9)] + [(1, 1)]
    t = Tables(
        orders=spark.createDataFrame(orders, "order_id long, created_at timestamp_ntz"),
        order_items=spark.createDataFrame(lines, "order_id long, product_id long, product_qty int"),
        flash_sales=spark.createDataFrame(sales, "flsh_trnid long, from_datetime timestamp_ntz, to_datetime timestamp_ntz"),
        flash_sale_lines=spark.createDataFrame(offered, "flsh_trnid long, product_id long"))
    at, when = dict(orders), {s: (a, b) for s, a, b in sales if a}
    want = {}
    for s, p in offered:
        hits = [q for o, product, q in lines if product == p and s in when and at[o] and when[s][0] <= at[o] <= when[s][1]]
        if hits:
            want[s, p] = want.get((s, p), 0) + sum(hits)
    assert rows(flash_sale_orders(t), "flsh_trnid", "product_id", "sold_qty") == sorted(((*k, v) for k, v in want.items()), key=repr)

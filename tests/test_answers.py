"""Every registered query against its SQL answer."""

import math

import pytest

import __spark_entry__ as entry

# Queries of the subpackage for training data have tests of their own.
OTHERS = set(entry.llm.QUERIES if entry.llm else ()) | {"pipeline"}
QUERIES = {k: v for k, v in entry.queries().items() if k not in OTHERS}
ANSWERS = {k: v for k, v in entry.oracle_sql().items() if k not in OTHERS}


def plain(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v

    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ANSWERS)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def compare(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cursor = duck.execute(ANSWERS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_answer(spark, duck, data, name):
    compare(spark, duck, data, name)


# Queries that cut hot keys, once more with nearly every key hot.
CUT = [
    "address_book", "tracking_timeline", "document_number", "order_document", "purchase_document",
    "invoice_document", "invoice_text", "admin_order_list", "customer_order_list", "user_orders",
    "order_header_detail", "user_order_history", "delivery_order_detail", "invoice_header", "nested_order_scan",
    "cart_merge", "default_address_set", "profile_update", "purchase_replace_lines", "purchase_item_cancel",
    "purchase_cancel_lines", "order_cancel_ledger", "order_state_apply_payments",
]


@pytest.mark.parametrize("name", CUT)
def test_answer_with_hot_keys(spark, duck, data, hot_at_five, name):
    compare(spark, duck, data, name)

"""The logical tables of one store.

A table belongs to a store by its own ``register_id``, or by the row it hangs
on: what a user owns belongs to the user's store, what belongs to an order to
the order's. Tables without an owner (catalogue, units, coupons, delivery
modes) are shared unless they are bound with a ``register_id`` of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.sources.tables import TABLE_NAMES, Tables

# Owner table, and the columns of the table and of its owner that meet.
OWNERS = {
    **{name: ("users", "user_id", "user_id")
       for name in ("orders", "addresses", "cart", "favourites", "coupon_usage", "reviews")},
    **{name: ("orders", "order_id", "order_id") for name in ("order_items", "payments", "tracking")},
    "ledger": ("purchases", "purchase_id", "purchaseid"),
    "flash_sale_lines": ("flash_sales", "flsh_trnid", "flsh_trnid"),
}
# The column that names the store, where it isn't ``register_id``.
OWN_COLUMN = {"purchases": "storeid"}


def register(t: Tables, register_id: int) -> int:
    """The store's number; a store that is not registered is an error."""
    if t.tenants.where(F.col("register_id") == register_id).isEmpty():
        raise LookupError(f"store {register_id} is not registered")
    return register_id


def rows_of(t: Tables, table: str, register_id: int) -> DataFrame:
    """Rows of a table that belong to a store."""
    rows = getattr(t, table)
    own = OWN_COLUMN.get(table, "register_id")
    if own in rows.columns:
        return rows.where(F.col(own) == register_id)
    if table not in OWNERS:
        return rows
    owner, column, key = OWNERS[table]
    owners = rows_of(t, owner, register_id).select(F.col(key).alias(column)).distinct()
    return rows.join(owners, column, "left_semi").select(*rows.columns)


def store_tables(t: Tables, register_id: int) -> Tables:
    """All logical tables as a registered store sees them, for any operator; a table is cut on first use."""
    register(t, register_id)
    return Tables(**{name: (lambda name=name: rows_of(t, name, register_id)) for name in TABLE_NAMES})

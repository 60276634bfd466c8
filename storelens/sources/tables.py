"""The logical retail tables that every operator reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

# Logical table names an operator may ask for.
TABLE_NAMES = (
    "tenants", "users", "addresses", "categories", "products", "units", "images",
    "orders", "order_items", "payments", "tracking", "cart", "favourites",
    "delivery_modes", "coupons", "coupon_usage", "partners", "reviews", "ledger",
    "purchases", "flash_sales", "flash_sale_lines",
)


class Tables:
    """Logical tables by name; a table is a DataFrame or a function that opens one.

    A function is called on first use only, so an operator that touches two
    tables opens two files.
    """

    def __init__(self, **bound: DataFrame | Callable[[], DataFrame]):
        unknown = set(bound) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._bound = bound

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._bound:
            raise AttributeError(f"table {name!r} is not bound")
        table = self._bound[name]
        if not isinstance(table, DataFrame):
            table = self._bound[name] = table()
        return table

    def replace(self, **bound: DataFrame) -> "Tables":
        """The same tables with some of them exchanged."""
        return Tables(**{**self._bound, **bound})

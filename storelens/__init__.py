"""Retail analytics operators for many stores at once, written for Spark."""

from storelens.sources.tables import Tables

__all__ = ["Tables"]

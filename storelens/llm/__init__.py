"""Operators for training data: one module for each, and their queries in ``registered``."""

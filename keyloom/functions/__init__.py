"""Predicates over keys, as Columns."""

"""Conditions over indexes and how they become DataFrames."""

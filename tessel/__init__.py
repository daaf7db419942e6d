"""Blocked dynamic programming over DataFrames."""

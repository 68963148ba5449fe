"""Operators over DataFrames, each for all tenants and periods at once."""

"""Operators over DataFrames: pure and lazy."""

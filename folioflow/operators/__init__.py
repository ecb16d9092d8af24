"""Operators: DataFrames to a DataFrame."""

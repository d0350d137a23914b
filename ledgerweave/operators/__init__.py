"""Reusable domain operators: each takes DataFrames and returns a DataFrame."""

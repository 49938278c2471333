"""Operators: DataFrames in, DataFrames out, lazy."""

"""Operators: pure functions from DataFrames to DataFrames, parameterised on column names."""

"""Operators: DataFrame in, DataFrame out; rule sets and column names are parameters."""

"""Operators: each takes and gives DataFrames and is used with `.transform` or called directly."""

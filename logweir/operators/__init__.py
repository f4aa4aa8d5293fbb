"""Operators over event logs: DataFrame in, DataFrame out."""

"""Operators: DataFrame in, DataFrame out. Every table carries the key `clip`, which all windows partition by."""

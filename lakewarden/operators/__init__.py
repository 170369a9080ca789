"""Operators: DataFrame and settings in, DataFrame out. None of them reads or writes a path."""

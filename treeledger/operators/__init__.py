"""Lazy operators: DataFrames in, DataFrames out."""

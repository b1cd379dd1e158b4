"""Operators on DataFrames: search, alignment, browsing, analytics and evaluation."""

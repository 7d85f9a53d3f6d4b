"""Operators over a log held as DataFrames."""

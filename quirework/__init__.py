"""Parallel-text analytics on Spark DataFrames."""

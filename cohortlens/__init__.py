"""Grouped, leakage-safe evaluation and matched-control inference on Spark DataFrames."""

"""Sparse-matrix analytics on Spark DataFrames."""

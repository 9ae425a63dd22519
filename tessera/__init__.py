"""Batch-first analytics and retrieval on Spark DataFrames."""

"""Tidemark: market-research analytics on Spark DataFrames."""

"""Fact and corpus processing on Spark DataFrames."""

"""Histogram and quantile analytics over Spark DataFrames."""

"""Chunked arrays, positional signals and byte indexes as Spark DataFrames."""

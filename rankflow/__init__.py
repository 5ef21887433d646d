"""Ranked-retrieval data preparation as Spark DataFrames."""

__version__ = "0.1.0"

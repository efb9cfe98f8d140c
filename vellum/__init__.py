"""Retrieval, embedding and text analytics on Spark DataFrames."""

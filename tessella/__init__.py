"""Batch retrieval, question answering and evaluation over document collections, as Spark DataFrames."""

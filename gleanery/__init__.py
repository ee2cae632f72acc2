"""Gleanery: content-curation analytics on Spark.

Every operator is a function from DataFrames to DataFrames built on Spark expressions.
"""

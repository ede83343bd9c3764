"""Trace and tree analytics on Spark DataFrames."""

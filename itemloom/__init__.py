"""Keyed-item analytics on Spark DataFrames."""

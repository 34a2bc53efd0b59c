"""Interferometric visibility analytics on Spark DataFrames."""

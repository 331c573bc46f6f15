"""Sequence and trajectory analytics on Spark DataFrames."""

"""Batch jobs for aligning networks at scale, written on Spark DataFrames."""

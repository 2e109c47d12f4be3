"""Segmill: timed-segment analytics and corpus preparation on Spark DataFrames."""

"""Time-series analytics on Spark DataFrames."""

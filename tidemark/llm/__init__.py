"""Training-data operators on Spark DataFrames, and the queries that apply them to whole tables."""

"""Change-timeline analytics on Spark DataFrames."""

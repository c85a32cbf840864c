"""evalweave: evaluation-data analytics on Spark DataFrames."""

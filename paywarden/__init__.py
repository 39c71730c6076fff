"""Payment-risk analytics on Spark DataFrames."""

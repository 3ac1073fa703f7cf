"""Map-data analytics on Spark DataFrames."""

"""weft: co-occurrence graph analytics on Spark DataFrames."""

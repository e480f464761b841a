"""Log-structured state analytics on Spark DataFrames."""

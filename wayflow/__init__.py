"""wayflow: congestion-aware route analytics on Spark DataFrames."""

"""Multiple-alignment analytics on Spark DataFrames."""

"""Family-inheritance analytics on Spark DataFrames."""

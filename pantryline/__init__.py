"""Place and menu analytics on Spark DataFrames."""

"""Play-value, projection and evaluation operators on Spark DataFrames."""

"""loomspan: profile and sequence alignment analytics over Spark DataFrames."""

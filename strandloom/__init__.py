"""Multi-region marker-gene reconstruction on Spark DataFrames."""

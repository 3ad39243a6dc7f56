"""Graph ordering, blocking and edge-centric analytics on Spark DataFrames."""

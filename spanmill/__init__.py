"""spanmill: interval, sequence and set analytics on Spark DataFrames."""

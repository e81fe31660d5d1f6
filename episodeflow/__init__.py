"""Analytics over time-indexed tensor episodes, on Spark DataFrames."""

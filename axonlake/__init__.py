"""Event, network and time-series analytics on Spark DataFrames."""

"""Time-decayed similarity, recommendation and trust analytics on Spark DataFrames."""

"""Timeline and catalogue analytics expressed on Spark DataFrames."""

"""Set-at-a-time retrieval, extraction-cleaning and graph analytics on Spark DataFrames."""

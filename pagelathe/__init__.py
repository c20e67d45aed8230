"""pagelathe: crawl-data analytics on Spark DataFrames."""

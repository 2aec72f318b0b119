"""Record linkage, deduplication and catalogue analytics on Spark DataFrames."""

"""lodestrata: record structuring, quality control and corpus preparation on Spark DataFrames."""

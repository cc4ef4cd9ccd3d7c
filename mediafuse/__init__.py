"""mediafuse: record linkage, fusion, search and corpus preparation on Spark DataFrames."""

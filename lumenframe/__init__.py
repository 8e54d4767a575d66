"""Medical-imaging data on Spark: scan, decode, query, rewrite and render with DataFrames."""

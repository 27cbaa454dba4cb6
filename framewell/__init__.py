"""Frame-sequence analytics on Spark: frames, pixels, blocks and mark sets as DataFrames."""

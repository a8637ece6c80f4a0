"""vinculum: property-graph analytics on Spark DataFrames."""

"""Entity features, product targeting and look-alike ranking on Spark DataFrames."""

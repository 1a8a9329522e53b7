"""graticule: grouped-experiment and surface-map analytics on Spark DataFrames."""

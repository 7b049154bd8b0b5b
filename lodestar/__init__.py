"""lodestar: approximate nearest-neighbour analytics over dense vectors, as Spark DataFrames."""

"""Graph analytics on Spark DataFrames: property graphs, importers, traversal, counting, sampling and learning on them."""

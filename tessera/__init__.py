"""tessera: relational analytics over skewed data, declared on Spark DataFrames."""

"""quantloom: panel and factor analytics expressed as Spark DataFrames."""

"""Search analytics on Spark DataFrames: an inverted index, a query language and ranking, expressed so that Catalyst plans them."""

"""tessera: relational SQL, keyed collections, streams and search, expressed as Spark DataFrames."""

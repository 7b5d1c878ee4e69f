"""tagloom: multi-label text and source-code analytics on Spark DataFrames."""

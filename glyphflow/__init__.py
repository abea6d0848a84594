"""glyphflow: multilingual text analytics on Spark DataFrames."""

"""shoebox: photo-library style analytics on Spark DataFrames."""

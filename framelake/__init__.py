"""framelake: media-metadata analytics on Spark DataFrames."""

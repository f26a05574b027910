"""Media-catalogue and conversion analytics on Spark DataFrames."""

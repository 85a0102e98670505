"""sparkboard: declarative analytics and text processing on Spark DataFrames."""

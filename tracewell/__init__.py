"""Where and how keywords are used across a source tree, as Spark DataFrames."""

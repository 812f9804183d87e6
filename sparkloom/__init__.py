"""An automated data-analysis engine on Spark DataFrames."""

"""Step-selection analysis of animal movement on Spark DataFrames."""

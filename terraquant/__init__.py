"""terraquant: tabular modelling, effect estimation and uncertainty on Spark DataFrames."""

"""Training-data operators: text in, DataFrames out. Nothing else in the package imports this folder."""

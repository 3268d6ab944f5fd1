"""Terminal-cell text layout and training-data operators on Spark DataFrames."""

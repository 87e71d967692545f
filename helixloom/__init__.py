"""Analytics for sequencing reads and variant calls, and training-data preparation, on Spark DataFrames."""

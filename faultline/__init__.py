"""Log-event normalization and error correlation on Spark DataFrames."""

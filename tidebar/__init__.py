"""tidebar: declarative OHLCV strategy analytics on Spark DataFrames."""

"""A research engine over company filings and web sources, on Spark DataFrames."""

"""Co-clustering of tables whose cells are time series, on Spark DataFrames."""

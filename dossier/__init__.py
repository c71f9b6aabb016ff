"""Document-archive analytics on Spark: DataFrame operators for search, labels, dates, observability and training data."""

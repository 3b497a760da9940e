"""Training-data analytics on Spark: DataFrame-to-DataFrame operators and streaming jobs."""

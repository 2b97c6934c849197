"""sluicework: ingestion-lifecycle analytics on Spark, with operators for training-data pipelines."""

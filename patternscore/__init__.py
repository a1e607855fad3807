"""patternscore: unusual-row scoring and corpus preparation on Spark."""

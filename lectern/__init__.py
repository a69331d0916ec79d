"""Document analytics and training-data processing on Spark."""

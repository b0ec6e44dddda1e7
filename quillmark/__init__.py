"""Script fingerprint analytics and training-data operators on Spark."""

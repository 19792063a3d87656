"""Spark-native analytics for large archives of threaded discussion."""

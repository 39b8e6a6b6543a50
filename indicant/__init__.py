"""Spark-native indicator analytics."""

"""Spark-native analytics for document key-information extraction."""

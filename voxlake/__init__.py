"""Spark-native analytics for chunked N-dimensional volumes."""

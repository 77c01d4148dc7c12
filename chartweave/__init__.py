"""Spark-native analytics for multi-site charts: features, geometry, sampling, alignment, metrics."""

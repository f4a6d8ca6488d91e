"""Spark-native analytics for sampled series, event tables and intervals."""

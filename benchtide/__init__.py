"""Spark-native analytics for benchmark runs: JSON documents in, series, changes and reports out."""

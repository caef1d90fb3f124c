"""Spark-native deduplication, similarity-layout and archive engine."""

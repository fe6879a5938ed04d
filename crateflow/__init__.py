"""Spark-native analytics for media libraries and discovery data."""

"""Spark-native satellite data-cube engine."""

"""Spark-native query engine over typed entities."""

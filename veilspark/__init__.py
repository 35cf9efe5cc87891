"""Spark-native disclosure-controlled analytics over person-level tables."""

"""Spark-native analytics for pulse traces and other large tables."""

"""Spark-native analytics of gridded phase-space data."""

"""Spark-native analytics for dual-channel physiological time series."""

"""Spark-native analytics for long linear sensor arrays."""

"""Spark-native analytics for population-genetics variant calls."""

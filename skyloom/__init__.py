"""Spark-native analytics for stacking, matching and cleaning dithered survey data."""

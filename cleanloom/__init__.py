"""Spark-native cleaning, scoring and transfer analysis of many tabular or time-ordered series."""

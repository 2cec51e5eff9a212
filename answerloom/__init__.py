"""Spark-native analysis of open-ended text answers."""

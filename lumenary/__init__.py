"""Spark-native search and analytics engine."""

"""Spark-native engine for structural and evaluation data."""

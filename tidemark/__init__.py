"""Tidemark: a Spark-native engine for revisable hourly time series."""

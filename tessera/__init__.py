"""Spark-native engine for single-cell DNA methylation tables."""

"""Spark-native longwave flux and uncertainty analytics."""

"""Spark-native panel forecasting, text linkage and reporting operators."""

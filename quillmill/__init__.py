"""Spark-native analytics for business documents and training corpora."""

"""Spark-native operators for image-and-tag training corpora."""

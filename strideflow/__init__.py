"""Spark-native motion analytics: accelerometer ETL, signal features, decoding, recaps."""

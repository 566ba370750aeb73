"""Spark-native analytics over incident graphs, vectors, records, logs and documents."""

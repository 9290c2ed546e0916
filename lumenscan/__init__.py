"""Spark-native analytics over source code, findings and documents."""

"""Spark-native analytics over multi-track symbolic music."""

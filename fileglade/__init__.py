"""Spark-native analytics over file-system metadata catalogs."""

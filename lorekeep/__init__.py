"""Spark-native analytics over searchable, self-consolidating records."""

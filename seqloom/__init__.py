"""Spark-native analytics over intervals, sequences and evidence records."""

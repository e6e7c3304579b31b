"""Spark-native analytics over batches of semi-structured text documents."""

"""Spark-native analytics over source files, conversations, web pages, logs and embeddings."""

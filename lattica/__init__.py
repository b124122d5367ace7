"""Spark-native vector search, document ingestion and retrieval."""

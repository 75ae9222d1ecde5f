"""Siltstone: Spark-first operators over text corpora, offers and training data."""

"""Corpus analytics on Spark: annotated-text statistics, retrieval, evidence and training-data preparation."""

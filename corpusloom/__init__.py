"""Corpus analytics and retrieval operators on PySpark."""

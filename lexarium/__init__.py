"""Lexarium: a PySpark-native analytics engine for archives of documents that cite one another."""

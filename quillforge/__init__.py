"""Corpus-wide document conversion tournament on PySpark."""

"""Webloom: a PySpark engine for building and measuring large web-text corpora."""

"""Operators for large text corpora, and the queries that apply them. Nothing else in the library imports this."""

"""Operators and queries for the preparation of language-model training data."""

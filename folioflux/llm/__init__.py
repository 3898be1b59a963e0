"""Operators for preparing language-model training text, with their queries and SQL."""

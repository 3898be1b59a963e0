"""Compositions of operators registered as named queries, with their SQL oracles."""

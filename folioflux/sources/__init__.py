"""Readers, keyed writers and the domain tables derived from the raw data."""

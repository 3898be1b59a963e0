"""Incremental file ingestion built on the batch operators."""

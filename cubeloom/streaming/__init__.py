"""Continuous ingestion of identifiers."""

"""Incremental refresh of stored indexes."""

"""Readers, writers and the shared store."""

"""Readers, writers and views over the given tables."""

"""Readers, writers and the keyed store."""

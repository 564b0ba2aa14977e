"""Readers, writers and hand-offs."""

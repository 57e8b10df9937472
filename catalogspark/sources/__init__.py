"""Readers, writers and the derived search index."""

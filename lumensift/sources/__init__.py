"""Corpora, datasets and saved state."""

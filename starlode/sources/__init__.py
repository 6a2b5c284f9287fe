"""Readers, writers and generators of star-schema data."""

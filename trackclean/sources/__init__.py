"""Readers, writers and derived tables."""

"""Readers, writers and validation."""

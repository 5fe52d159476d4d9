"""Readers, writers and the schema registry."""

"""Readers, writers, catalog and staging."""

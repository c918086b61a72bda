"""Watching a registry's status log as a stream."""

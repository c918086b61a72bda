"""Operators on lattices, vectors and tables."""

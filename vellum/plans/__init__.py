"""Relational plans over the star-schema tables."""

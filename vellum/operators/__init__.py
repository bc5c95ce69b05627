"""Relational operators over documents, notes and links."""

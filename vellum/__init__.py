"""Vellum: document and note-graph analytics as PySpark plans."""

"""Quirework: document-structure and conservation checks as Spark plans."""

__version__ = "0.1.0"

"""Readers, parsers and adapters that make elements."""

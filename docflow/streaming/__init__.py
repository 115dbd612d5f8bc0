"""Conversion tasks as streams, and their status."""

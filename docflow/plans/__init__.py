"""Whole plans: rendering, the processing registry, conversion."""

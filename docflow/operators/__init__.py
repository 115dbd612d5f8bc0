"""Relational operators over elements, boxes and trees."""

"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; it can be removed as a whole. Keys of documents, pages, items and
conversations are whole numbers; they are cast to long, so a key that is no number fails under ANSI rules.
"""

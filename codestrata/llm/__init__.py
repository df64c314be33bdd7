"""Operators for large text corpora: deduplication, search, tokenising, language, personal data, storage and mixing.

Nothing else in the library imports this folder.
"""

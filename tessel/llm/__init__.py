"""Training-data operators: filtering, deduplication, scoring, tokenising and packing of documents.

Nothing else in the library imports this subpackage.
"""

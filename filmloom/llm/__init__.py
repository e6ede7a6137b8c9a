"""Training-data operators: dedup, filtering, token counting, scoring, mixing and packing of documents.

Nothing else in the package imports this subpackage.
"""

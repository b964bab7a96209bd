"""Training-data operators: dedup, mixing, filtering, tokenising and rendering of large corpora.

Nothing else in the library imports this subpackage.
"""

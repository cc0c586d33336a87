"""Training-data operators: deduplication, tokenisation, formatting, privacy, search and scoring.

Nothing else in the library imports this subpackage.
"""

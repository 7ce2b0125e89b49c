"""Operators for preparing training text: deduplication, tokens, models, filters."""

"""Operators for preparing training text: archives, filters, duplicates, tokens, shards."""

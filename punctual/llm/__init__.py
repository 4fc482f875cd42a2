"""Operators that prepare training text: tokens, duplicates, quality, languages, packing."""

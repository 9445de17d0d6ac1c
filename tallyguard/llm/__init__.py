"""Operators for preparing training text: filters, near-duplicates, mixing, encoding, scoring."""

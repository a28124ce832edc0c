"""Operators for preparing training text: mixing, encoding, filtering,
near-duplicate search, identification and scoring. ``queries`` registers them."""

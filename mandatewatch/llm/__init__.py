"""Operators for preparing training data: search, dedup, tokenizing, packing, language ID."""

"""Operators for training-data preparation: duplicates, quality, tokens, packing, archives."""

"""Operators for text corpora: language, likelihood, fingerprints, quality, secrets, duplicates, packing, byte pairs."""

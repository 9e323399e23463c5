"""Operators for building training corpora: sharding, archives, dedup, quality, token files, language ID and tokenizing."""

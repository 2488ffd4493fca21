"""Operators for preparing training text: deduplication, fingerprints, quality, language, tokens, mixing, chat."""

"""Operators of a training-data pipeline: tokens, languages, fingerprints, mixing, scoring,
de-duplication, personal data and quality rules. Nothing else in the library imports this."""

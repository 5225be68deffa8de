"""Operators of a training-data pipeline: packing, extraction, mixing, quality
rules, near-duplicates, language, fingerprints, license scans, repeated
passages and chat formatting. Nothing outside this folder imports it."""

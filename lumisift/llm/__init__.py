"""Operators for training-data pipelines: quality, personal data, toxicity, extraction, duplicates, mixing, leaks."""

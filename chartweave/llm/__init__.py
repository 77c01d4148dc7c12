"""Operators for training data: scans, deduplication, extraction, scoring, tokens."""

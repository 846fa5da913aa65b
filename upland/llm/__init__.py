"""Operators for large-scale training data: filtering, deduplication, scanning, mixing and tokenising."""

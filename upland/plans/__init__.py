"""Compound city jobs."""

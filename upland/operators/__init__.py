"""DataFrame operators built from the column helpers."""

"""Column functions and small aggregate helpers."""

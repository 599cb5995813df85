"""Event processing: the same functions serve tables (batch) and streams."""

"""Distributed plans for steps whose obvious form would pull one key, or the whole table, into one task."""

"""Readers and writers: tables, customer profiles, events, reports."""

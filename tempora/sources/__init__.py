"""Scans of the tables and of the external formats."""

"""Readers of tables, files and landing zones, and writers."""

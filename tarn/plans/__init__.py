"""Registered queries, the flagship, and the pipeline runner."""

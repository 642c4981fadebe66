"""Lakehouse pipelines as plain Spark: merge strategies, quality gates, history, streams."""

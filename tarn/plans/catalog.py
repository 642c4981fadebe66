"""Every registered query and its DuckDB equivalent."""

from tarn.plans import queries_history, queries_marts, queries_merge, queries_ordered, queries_quality, queries_sources, queries_streams, queries_versions  # noqa: F401
from tarn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

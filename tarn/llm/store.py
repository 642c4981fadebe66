"""Shipping this package to Python workers, and what operators keep there."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from tarn.storage import save, scope

__all__ = ["kept", "save", "scope", "ship"]

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="tarn-py-"), "tarn_llm_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in [root / "__init__.py", root / "storage.py", *sorted((root / "llm").glob("*.py"))]:
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task; other operators' share is let go.

    Workers are reused by later stages, whose memory must not hold the memos of earlier ones.
    """
    others = [k for k in _KEPT if k != owner]
    for other in others:
        del _KEPT[other]
    if others:
        give_back()
    return _KEPT.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the system, where the C library and Arrow can: a worker lives as long as its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

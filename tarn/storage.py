"""Shared storage for intermediate data: where it lies, and when it is removed."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_ROOT: dict[str, str] = {}
_LEAVE: list[Callable[[], None]] = []
#: Open scopes, innermost last; each thread has its own.
_SCOPES: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


def use_root(path: str) -> None:
    """Put intermediate data under ``path``, a folder that every executor sees, where ``spark.checkpoint.dir`` is not set."""
    _ROOT["path"] = path.rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder of ``use_root``, else on a local master a temporary folder.

    On a cluster with neither setting this raises: a local folder of one machine would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if "path" not in _ROOT:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir, or call tarn.storage.use_root, with a folder that all executors share")
        use_root("file://" + tempfile.mkdtemp(prefix="tarn-"))
    return _ROOT["path"]


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name in the shared root. It is removed at the end of the open scope, with ``keep`` when the process ends."""
    path = f"{shared_root(spark)}/tarn-{uuid.uuid4().hex[:12]}-{name}"
    open_scopes = _SCOPES.get()
    if open_scopes and not keep:
        open_scopes[-1].append((spark, path))
    else:
        at_exit(lambda: delete(spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, as full paths; nothing if there is no such folder."""
    if not exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().toString() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target))


def save(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared root and read it back: cuts the lineage, survives lost executors.

    Inside a ``scope`` it is gone once the scope ends, unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = new_folder(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """What ``save`` writes inside is deleted at the end; whoever reads it has to be done by then."""
    own: list[tuple[SparkSession, str]] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for spark, path in own:
            delete(spark, path)


def at_exit(action: Callable[[], None]) -> None:
    """Run an action when the process ends, for things that lazy results still read."""
    _LEAVE.append(action)


@atexit.register
def clean_up() -> None:
    """Remove what is left over now; results that were not read yet can't be read any more."""
    while _LEAVE:
        try:
            _LEAVE.pop()()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return

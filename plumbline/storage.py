"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back, so a lost executor
costs one task and not the whole chain of stages before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are threads of this
    process gets a temporary folder; any other must name a folder that its
    executors share, and fails here rather than on a lost executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="plumbline-")
    return f"file://{_own[app]}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes with the session at the latest."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._plumbline_path = path
    if _scopes:
        _scopes[-1].append(kept)
    return kept


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`keep` wrote and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_plumbline_path", None)
        if path:
            system, target = _file_system(table.sparkSession, path)
            system.delete(target, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables kept inside; those to stay are taken off the list it gives."""
    tables: list[DataFrame] = []
    _scopes.append(tables)
    try:
        yield tables
    finally:
        _scopes.remove(tables)
        drop(*tables)


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one, ``row``.

    However the columns of a table are called, they can't clash with those
    that an operator adds; ``select("row.*")`` brings them back.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

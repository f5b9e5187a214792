"""Sends this package to the executors of a session that may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Bytes of an Arrow batch, which stands in the executor and in its Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package's source as a Python file of the application, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="plumbline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    context.addPyFile(name)
    _sent.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it bounds them already.

    Spark's own bound is in rows, so long texts make batches as large as an
    input split.  Plans read the setting when they run, so it stays; rows are
    neither cut nor dropped, and one beyond the bound is a batch of its own.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))

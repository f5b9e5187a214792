"""Analyzer results as JSON: one document for all, or tables for Spark's own writers."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json_rows(name: str, issues: DataFrame) -> DataFrame:
    """``(analyzer, issue)`` with each issue as a JSON text; writes like any table."""
    return issues.select(F.lit(name).alias("analyzer"), F.to_json(F.struct("*")).alias("issue"))


def write_report(results: dict, out: TextIO) -> None:
    """``{analyzer: {summary, issues}}`` with every issue, which stream through the driver a partition at a time."""
    out.write("{")
    for k, (name, result) in enumerate(results.items()):
        summary = json.dumps(result.summary.first()[0], ensure_ascii=False)
        out.write(f'{"," if k else ""}\n  {json.dumps(name)}: {{"summary": {summary}, "issues": [')
        for n, row in enumerate(as_json_rows(name, result.issues).toLocalIterator()):
            out.write(("," if n else "") + "\n    " + row.issue)
        out.write("]}")
    out.write("\n}\n")


def write_tables(results: dict, folder: str) -> None:
    """Every analyzer's issues as JSON lines in a folder of its name, written by the executors."""
    for name, result in results.items():
        as_json_rows(name, result.issues).select("issue").write.text(f"{folder.rstrip('/')}/{name}")

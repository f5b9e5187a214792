"""A hash over all columns of a row, which tells rows that share an id apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(docs: DataFrame, prefix: str = "") -> Column:
    """64-bit hash of a row of ``docs``, whose columns stand under ``prefix``; maps are hashed as JSON."""
    columns = []
    for name, kind in docs.dtypes:
        column = F.col(f"{prefix}`{name}`")
        columns.append(F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column)
    return F.xxhash64(*columns)

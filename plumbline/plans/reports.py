"""Issues in reading order, the preset catalogue and the graph of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_rules as fixed


def in_order(name: str, issues: DataFrame) -> DataFrame:
    """Issues of the named analyzer as a person reads them; paths sort by component."""
    place = lambda column: F.split(column, "/")
    has = set(issues.columns)
    rank = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("confidence") if "confidence" in has else F.lit(""))
    uncovered = [F.desc(F.col("total_tests") == 0)] if "total_tests" in has else []
    sizes = [F.desc_nulls_last(c) for c in ("loc", "method_count") if c in has]
    by_file = [place("file"), *(["line"] if "line" in has else [])] if "file" in has else []
    orders = {
        "coverage": uncovered + by_file,
        "observability": by_file,
        "dead_code": [rank, "symbol"],
        "solid": [*(["type"] if "type" in has else []), *sizes, *by_file],
        "taxonomy": by_file,
        "folder_structure": [place("folder")] if "folder" in has else [],
        "repo_rules": by_file,
        "metrics": [F.desc("files")] if "files" in has else [],
    }
    return issues.orderBy(*orders[name]) if orders.get(name) else issues


def presets(spark: SparkSession) -> DataFrame:
    """``(preset, name, pattern, severity, n_literals, message)`` of the built-in content rules."""
    rows = [(p, n, g, s, len(f), m) for p, rules in fixed.CONTENT.items() for n, g, f, s, m in rules]
    return spark.createDataFrame(rows, "preset string, name string, pattern string, severity string, n_literals int, message string")


def change_graph(callers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of :meth:`BlastRadius.callers`, each once."""
    nodes = (
        callers.select(F.col("changed").alias("name"), F.col("changed_path").alias("path"), F.lit("changed").alias("role"))
        .unionByName(callers.select(F.col("caller").alias("name"), F.col("caller_path").alias("path"), F.col("relation").alias("role")))
        .groupBy("name", "path")
        .agg(F.min("role").alias("role"))
    )
    edges = callers.select(
        F.col("caller").alias("source"),
        F.col("changed").alias("target"),
        F.when(F.col("is_covered"), "covered").otherwise("uncovered").alias("colour"),
    ).distinct()
    return nodes, edges


def recent(visits: DataFrame, name: str, at: str, limit: int) -> DataFrame:
    """The ``limit`` names visited last, latest first, each once."""
    latest = visits.groupBy(name).agg(F.max(at).alias(at))
    return latest.orderBy(F.desc(at), name).limit(limit)

"""Pre-write checks: a proposed text in, a verdict out, in batch or as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_hit(rules: list[dict], severity: str, text: Column, path: Column | None) -> Column:
    checks = []
    for rule in rules:
        if rule["severity"] != severity or not rule["forbidden"]:
            continue
        hits = [text.rlike(f"(?m){f}") if rule.get("is_regex") else F.contains(text, F.lit(f)) for f in rule["forbidden"]]
        hit = reduce(lambda a, b: a | b, hits)
        if path is not None and rule.get("path_regex"):
            hit = hit & path.rlike(rule["path_regex"])
        checks.append(hit)
    return F.coalesce(reduce(lambda a, b: a | b, checks), F.lit(False)) if checks else F.lit(False)


def verdicts(events: DataFrame, rules: list[dict], text: Column, path: Column | None = None) -> DataFrame:
    """Adds ``blocked`` (an error rule hits) and ``warned`` (a warning rule hits).

    The rules are constants, so every event keeps its row, a null or empty
    text is allowed through, and the same plan runs on a stream.
    """
    body = F.coalesce(text, F.lit(""))
    return events.withColumns(
        {"blocked": _any_hit(rules, "error", body, path), "warned": _any_hit(rules, "warning", body, path)}
    )


#: Payload of a write event.
EVENT_SCHEMA = "tool_name string, tool_input struct<file_path:string,content:string,new_string:string>"


def write_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(tool_name, path, text)`` from JSON lines; malformed ones and other tools come out with a null text."""
    parsed = lines.withColumn("_e", F.from_json(column, EVENT_SCHEMA, {"mode": "PERMISSIVE"}))
    is_write = F.col("_e.tool_name").isin("Write", "Edit")
    return parsed.select(
        F.col("_e.tool_name").alias("tool_name"),
        F.replace(F.col("_e.tool_input.file_path"), F.lit("\\"), F.lit("/")).alias("path"),
        F.when(is_write, F.coalesce("_e.tool_input.content", "_e.tool_input.new_string")).alias("text"),
    )


def check_stream(lines: DataFrame, rules: list[dict], column: str = "value") -> DataFrame:
    """Verdicts of a stream (or batch) of write events, with the exit code a hook returns."""
    checked = verdicts(write_events(lines, column), rules, F.col("text"), F.col("path"))
    return checked.withColumn("exit_code", F.when(F.col("blocked"), 2).otherwise(0))

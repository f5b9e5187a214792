"""Connected components of an edge table, as alternating star contractions.

Every step is a grouped minimum and a join: no component, no adjacency list
and no edge ever meets in one task or on the driver.  Minima are written
first, so the join after them reads two plain tables and adaptive execution
may split the key of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, keep


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row.n, int(row.s or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``.

    ``component`` is the smallest node reachable.  Loops and repeated edges
    are ignored; nodes without an edge to another node are not returned; an
    empty table gives an empty one.
    """
    base = keep(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _signature(base)
    current = base
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")), "star-min")
        large = keep(
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .distinct(),
            "large-star",
        )
        under = keep(large.groupBy("a").agg(F.min("b").alias("m")), "star-min")
        step = large.join(under, "a")
        small = keep(
            step.select("a", F.col("m").alias("b"))
            .unionByName(step.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct(),
            "small-star",
        )
        drop(current, low, large, under)
        now = _signature(small)
        current = small
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))

"""Relational operators that know column names but nothing of code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, keep

#: Rules whose matches are gathered in one array; more make more arrays over the same line.
RULES_AT_ONCE = 200


def scan_rules(
    docs: DataFrame, rules: list[dict], key_cols: list[str], lines: Column, path: Column | None = None
) -> DataFrame:
    """One row for each (document, rule, line) in which a literal or pattern of the rule occurs.

    ``rules`` are dicts with ``name``, ``severity``, ``message``,
    ``forbidden`` (literals, or regular expressions if ``is_regex``) and
    optionally ``path_regex``.  At most one row for a rule and line, with the
    first literal that fits.  The rules, however many, are constants of the
    plan, checked inside one pass over the lines, so nothing is shuffled;
    documents that no rule's path fits are dropped before their lines are
    looked at.
    """

    def hit(rule, text):
        fits = [
            F.when(text.rlike(f) if rule.get("is_regex") else F.contains(text, F.lit(f)), F.lit(f))
            for f in rule["forbidden"]
        ]
        found = F.coalesce(*fits) if fits else F.lit(None).cast("string")
        if path is not None and rule.get("path_regex"):
            found = F.when(path.rlike(rule["path_regex"]), found)
        return found

    if path is not None and rules and all(r.get("path_regex") for r in rules):
        docs = docs.where(reduce(lambda a, b: a | b, [path.rlike(r["path_regex"]) for r in rules]))
    exploded = docs.select(
        *key_cols, *([path.alias("_path")] if path is not None else []), F.posexplode(lines).alias("pos", "line_text")
    )
    if path is not None:
        path = F.col("_path")
    found = [
        F.when(
            hit(r, F.col("line_text")).isNotNull(),
            F.struct(
                F.lit(r["name"]).alias("rule"),
                F.lit(r["severity"]).alias("severity"),
                F.lit(r["message"]).alias("message"),
                hit(r, F.col("line_text")).alias("literal"),
            ),
        )
        for r in rules
    ]
    parts = [F.array_compact(F.array(*found[k : k + RULES_AT_ONCE])) for k in range(0, len(found), RULES_AT_ONCE)]
    matches = F.concat(*parts) if parts else None
    if not rules:
        schema = "struct<rule:string,severity:string,message:string,literal:string>"
        matches = F.array().cast(f"array<{schema}>")
    return exploded.select(
        *key_cols, (F.col("pos") + 1).alias("line"), F.trim("line_text").alias("matched"), F.explode(matches).alias("m")
    ).select(*key_cols, "line", "m.rule", "m.severity", "m.literal", "m.message", "matched")


def document_frequency_one(tokens: DataFrame, doc_col: str, token_col: str) -> DataFrame:
    """``(doc, token)`` of tokens that occur in no other document: two aggregations, no self join."""
    return (
        tokens.groupBy(token_col)
        .agg(F.min(doc_col).alias("_low"), F.max(doc_col).alias("_high"))
        .where(F.col("_low") == F.col("_high"))
        .select(F.col("_low").alias(doc_col), token_col)
    )


def overlap_semi(left: DataFrame, right: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows of ``left`` whose closed interval meets one of ``right`` with the same key.

    Both tables have the key, start and end columns.  In the order of
    positions, a row of ``left`` stands at its end; it is met if, of the
    intervals of ``right`` that start up to there, the one that reaches
    furthest reaches its start.  One running maximum answers that, so no
    pairs are formed, and a key with very many intervals is spread over
    tasks.  Rows without a key, start or end meet nothing.
    """
    whole = F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row")
    asked = left.where(whole & (F.col(start) <= F.col(end))).select(
        F.col(key).alias("_key"), F.col(end).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(dict(right.dtypes)[end]).alias("_reach"), F.col(start).alias("_from"), row,
    )
    given = right.where(whole & (F.col(start) <= F.col(end))).select(
        F.col(key).alias("_key"), F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(end).alias("_reach")
    )
    events = asked.unionByName(given, allowMissingColumns=True)
    furthest = running(events, ["_key"], ["_at", "_side"], F.col("_reach"), "_furthest", "max", spread=True)
    return furthest.where((F.col("_side") == 1) & (F.col("_furthest") >= F.col("_from"))).select("_row.*")


def other_owner_semi(refs: DataFrame, owners: DataFrame, name: str, place: str) -> DataFrame:
    """References to a name that some other place owns.

    A name's owners are summed up first (smallest and largest place), so the
    join is many to one and a name that everybody owns adds no pairs.
    """
    known = owners.groupBy(F.col(name).alias("_n")).agg(F.min(place).alias("_low"), F.max(place).alias("_high"))
    elsewhere = (F.col("_low") != F.col(place)) | (F.col("_high") != F.col(place))
    return refs.join(known, F.col(name) == F.col("_n")).where(elsewhere).select(refs.columns)


def bounded_reach(edges: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """``(node, depth)``: fewest edges from a start node, at most ``limit``.

    Level by level; a level joins only nodes seen first on the one before,
    and is written before the next, so plans stay one level deep.  Without a
    limit the levels end with the first that finds nothing new.
    """
    seen = level = keep(start.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    depth = 0
    while limit is None or depth < limit:
        depth += 1
        level = keep(
            level.select("node")
            .join(edges, F.col("node") == F.col("src"))
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
            .withColumn("depth", F.lit(depth)),
            "reach",
        )
        if not level.head(1):
            drop(level)
            break
        seen = seen.unionByName(level)
    return seen


def first_visitor(edges: DataFrame, name: str, order: list) -> DataFrame:
    """The first edge that reaches each name."""
    return (
        edges.withColumn("_rn", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
        .where("_rn = 1")
        .drop("_rn")
    )


#: How a running value is taken: over a window, over a whole stretch, and from the stretches before.
_RUNNING = {
    "last": (
        lambda v: F.last(v, ignorenulls=True),
        lambda v, order: F.max_by(v, F.when(v.isNotNull(), F.struct(*order))),
        lambda before, here: F.coalesce(here, before),
    ),
    "max": (F.max, lambda v, order: F.max(v), lambda before, here: F.greatest(before, here)),
    "sum": (F.sum, lambda v, order: F.sum(v), lambda before, here: F.coalesce(before + here, before, here)),
}


def running(
    table: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    alias: str,
    how: str = "last",
    spread: bool = False,
    current: bool = True,
) -> DataFrame:
    """Adds ``alias``: the last non-null, largest or summed ``value`` of the key's rows up to each one.

    Null values are passed over; ``current`` says whether a row's own value
    counts.  With ``spread``, and always where there is no key, rows are
    dealt to tasks by ranges of key and order, so no task need hold a whole
    key.  Only a key at an end of a range can go on in another; the results
    of such stretches, at most two a range, are carried over.  Rows that tie
    in ``order`` have no order among them.
    """
    window, whole, carry = _RUNNING[how]
    bounds = (Window.unboundedPreceding, 0 if current else -1)
    if keys and not spread:
        return table.withColumn(alias, window(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*bounds)))
    named = table.withColumns({"_v": value, "_key": F.struct(*keys) if keys else F.struct(F.lit(0))})
    ranged = keep(named.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()), "running")
    ends = ranged.groupBy("_part").agg(F.min("_key").alias("low"), F.max("_key").alias("high"))
    edge = ends.select(F.explode(F.array("low", "high")).alias("_edge")).distinct()
    stretches = (
        ranged.join(F.broadcast(edge), F.col("_key") == F.col("_edge"), "left_semi")  # two rows a range
        .groupBy("_key", "_part")
        .agg(whole(F.col("_v"), order).alias("_v"))
    )
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(
        F.col("_key").alias("_k"), F.col("_part").alias("_p"), window(F.col("_v")).over(before).alias("_before")
    ).where("_before is not null")
    inside = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(*bounds)
    return (
        ranged.withColumn(alias, window(F.col("_v")).over(inside))
        .join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & (F.col("_key") == F.col("_k")), "left")  # two rows a range
        .withColumn(alias, carry(F.col("_before"), F.col(alias)))
        .select(*[F.col(f"`{c}`") for c in table.columns], alias)
    )


def forward_fill(
    table: DataFrame, key: str | None, order: list[str], value: Column, alias: str, spread: bool = False
) -> DataFrame:
    """The last non-null value up to each row, within ``key``; see :func:`running`."""
    return running(table, [key] if key else [], order, value, alias, "last", spread)


def union_issues(*tables: DataFrame) -> DataFrame:
    """Issue tables of different columns under one another."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

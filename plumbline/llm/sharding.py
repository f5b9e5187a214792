"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a document's hash.  A bucket
over the byte limit is split on the next bit, others stay, until every shard
fits or holds one hash alone.  Only byte sums of hash prefixes decide, so
documents move once, to their shard, or not at all.  A shard is a prefix of
the hash and becomes one file, which holds the whole rows.

Splitting goes in rounds of a few bits.  A round sums the cells of its
deepest bits that hold a row, a few a shard, and names for each such cell the
shard it falls into; only rows of buckets that are still too full go on to
the next round.  Bit patterns that no row has are never listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, keep

LIMIT_BYTES = 1 << 20
#: Hash bits; prefixes are taken from the highest.
BITS = 60
#: Bits that the first round looks past the depth that even hashing would need, and later rounds past the last.
AHEAD = 2
AHEAD_LATER = 5


def _hash(id_col: str) -> Column:
    """The leading ``BITS`` bits of the id's hash."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")


def _shard_id() -> Column:
    bits = F.expr("right(lpad(conv(cast(prefix AS string), 10, 2), 64, '0'), depth)")
    return F.when(F.col("depth") > 0, bits).otherwise("")


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keep(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), _size(text_col).alias("bytes"), _hash(id_col).alias("h")
        ),
        "sized",
    )


def _cells(sized: DataFrame, limit_bytes: int) -> list[tuple[int, DataFrame]]:
    """By round, its bits and ``(cell, prefix, depth, shard_bytes)``: the shard of each cell of so many bits."""
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    top, open_, found = 0, sized, []
    reach = max(0, math.ceil(math.log2(max(total, 1) / limit_bytes))) + AHEAD
    while True:
        reach = min(reach, BITS)
        cells = keep(
            open_.groupBy(F.shiftright("h", BITS - reach).alias("cell")).agg(
                F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")
            ),
            "cells",
        )
        above = F.expr(f"shiftright(cell, {reach} - depth)").alias("prefix")
        at = F.explode(F.sequence(F.lit(top), F.lit(reach))).alias("depth")
        buckets = (
            cells.select("cell", "bytes", "low", "high", at)
            .groupBy("depth", above)
            .agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        )
        # a bucket of one hash can't be split
        settled = (F.col("bytes") <= limit_bytes) | (F.col("low") == F.col("high"))
        shards = keep(buckets.where(settled).select("depth", "prefix", F.col("bytes").alias("shard_bytes")), "settled-buckets")
        # the shallowest settled bucket over a cell is its shard
        placed = keep(
            cells.select("cell", at)
            .select("cell", "depth", above)
            .join(shards, ["depth", "prefix"])
            .groupBy("cell")
            .agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("x"))
            .select("cell", "x.prefix", "x.depth", "x.shard_bytes"),
            "shard-cells",
        )
        found.append((reach, placed))
        drop(shards)
        full = keep(cells.join(placed, "cell", "left_anti").select(F.col("cell").alias("full")), "full-buckets")
        if not full.head(1):
            return found
        open_ = sized.join(full, F.shiftright("h", BITS - reach) == F.col("full"), "left_semi")
        top, reach = reach + 1, reach + AHEAD_LATER


def _placed(rows: DataFrame, cells: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (with ``h``) beside their shard: those of a round's cells by one join on equal cells."""
    placed = None
    for reach, directory in cells:
        part = rows.join(directory, F.shiftright("h", BITS - reach) == F.col("cell")).drop("cell")
        placed = part if placed is None else placed.unionByName(part)
    return placed


def assign_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES
) -> DataFrame:
    """``(doc_id, bytes, shard_id, depth, shard_bytes)``, one row for each input row.

    ``shard_id`` is the bucket's bits.  A null text has no bytes, a very long
    one all of its bytes; a null id hashes like the text ``null``.  Rows that
    repeat an id have one hash and share a shard.  A bucket whose rows all
    have one hash, such as a single document over the limit, cannot be split,
    stays where it first stands alone, and is the only kind that may exceed
    the limit.  Other columns, whatever their names, are not read.  An empty
    table gives an empty one.
    """
    sized = _sized(docs, id_col, text_col)
    return _placed(sized, _cells(sized, limit_bytes)).select(
        "doc_id",
        "bytes",
        _shard_id().alias("shard_id"),
        F.col("depth").cast("int").alias("depth"),
        "shard_bytes",
    )


def write_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES
) -> None:
    """Writes every row of ``docs``, with all its columns, to the file of its shard.

    The shards are those of :func:`assign_shards`: one Parquet file for each,
    in the folder ``shard=s<bits>`` under ``path``, which must not exist.
    Rows are kept whole in a column ``row`` and read by :func:`read_shards`.
    An empty table gives a folder without shards.
    """
    cells = _cells(_sized(docs, id_col, text_col), limit_bytes)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _hash(id_col).alias("h"))
    if not cells[0][1].head(1) and len(cells) == 1:  # no rows: a folder that can be read
        rows.select("row", F.lit("s").alias("shard")).write.parquet(path)
        return
    if len(cells) > 1:  # the texts are read once: every round's cells in one directory
        reaches = [reach for reach, _ in cells]
        rows = rows.withColumn(
            "at", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.shiftright("h", BITS - r).alias("c")) for r in reaches]))
        )
        each = [directory.withColumn("reach", F.lit(reach)) for reach, directory in cells]
        directory = each[0]
        for one in each[1:]:
            directory = directory.unionByName(one)
        placed = rows.join(directory, (F.col("at.r") == F.col("reach")) & (F.col("at.c") == F.col("cell")))
    else:
        placed = _placed(rows, cells)
    # all rows of a shard meet in one task, so a shard is one file
    placed.select("row", F.concat(F.lit("s"), _shard_id()).alias("shard")).repartition("shard").write.option(
        "maxRecordsPerFile", 0
    ).partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(row, shard_id)`` of every row that :func:`write_shards` wrote."""
    return spark.read.parquet(path).select("row", F.expr("substring(shard, 2)").alias("shard_id"))

"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents should appear ``target / size`` times each.  The whole
part is taken as it is; the fractions are rounded by the pivotal method: two
documents at a time, words of probability mass move from one to the other
until one of them is taken or left out for certain, with the direction drawn
so that neither's expectation changes.  Mass is counted in words, so what a
source gives stays at its target up to the one document left at the end.

The pairs form a reduction tree.  Leaves are hash buckets of about ``FAN``
documents of a source, each rounded in one fold, the largest first; the one
document that a bucket leaves open goes up, ``FAN`` buckets to a parent,
until a source has a single open document, whose fraction is drawn.  No task
sees more than about ``FAN`` documents of a source at a time, however large
the source.

The last open document may be a large one and leave its source off the target
by as much as itself.  What is missing (or too much) is then made up for by
copies of other documents, the largest that fits first, out of at most
``SLOTS`` of each power of two of sizes.  Expectations are thus kept up to that last
document's mass.

Rows are told apart by their id and a hash over all their columns, and equal
rows by a number among them, so rows that repeat an id, or have none, are
rounded and found again one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep, wrapped
from .quality_rules import SEPARATORS
from .rowkeys import row_key

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a source's words are taken.
MAX_COPIES = 3
#: Open documents that one fold rounds, in expectation.
FAN = 256
#: Documents of each power of two of sizes that may make up for what a source misses.
SLOTS = 64
#: Equal rows that one task numbers.
NUMBERED_AT_ONCE = 1 << 20
SEED = 6

_ID = "struct<doc_id:bigint,key:bigint,n:bigint>"
_OPEN = f"struct<id:{_ID},size:bigint,w:double>"
_DONE = f"array<struct<id:{_ID},size:bigint,up:int>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SEPARATORS), lambda w: w != "")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the 0-based place of ``source`` by code point, null last.

    Sorted in range partitions; only their row counts, one for each
    partition, pass through the driver.
    """
    order = F.col("source").asc_nulls_last()
    ranged = keep(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())
    offsets, before = [], 0
    for part, count in sizes:
        offsets.append((part, before))
        before += count
    # constants of the plan: rows of Python values would start Python workers on the executors
    rows = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(n).cast("long").alias("before")) for p, n in offsets or [(0, 0)]])
    start = ranged.sparkSession.range(1).select(F.inline(rows))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(start), "part").select(
        *sources.columns, (F.col("before") + F.col("inside")).alias("rank")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, n_docs, rank, target)`` from ``(source, size, rows)``: ``rows`` documents of that size.

    Every source aims at ``share * weight``, where ``share`` is what makes
    the targets add up to all words; targets stop at ``max_copies`` times
    their source, and the share rises until the rest takes the excess.
    """
    weight = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        weight = F.when(F.col("rank") % len(weights) == k, w).otherwise(weight)
    summed = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n_docs"))
    ranked = keep(_ranked(summed).withColumn("weight", weight.cast("long")), "ranked-sources")
    cap = max_copies * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while total:
        stopped = F.col("weight") * F.lit(share) > cap
        row = ranked.agg(
            F.sum(F.when(stopped, cap).otherwise(0)).alias("used"),
            F.sum(F.when(stopped, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        raised = (total - row.used) / row.weight if row.weight else share
        if raised <= share:
            break
        share = raised
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(share)))


def _step(state: Column, nxt: Column) -> Column:
    """One pivotal step between the open document of ``state`` and the next one."""
    a = state["open"]
    a_up = F.least(a["size"] - a["w"], nxt["w"])
    b_up = F.least(nxt["size"] - nxt["w"], a["w"])
    draw = F.shiftrightunsigned(F.xxhash64(a["id"], nxt["id"], F.lit(SEED)), 11) / F.lit(float(1 << 53))
    to_a = F.coalesce(draw < F.try_divide(b_up, a_up + b_up), F.lit(False))
    a_full = a["size"] - a["w"] <= nxt["w"]
    b_full = nxt["size"] - nxt["w"] <= a["w"]
    a_settled = F.when(to_a, a_full).otherwise(~b_full)
    still = F.when(a_settled, nxt["id"]).otherwise(a["id"])
    still_size = F.when(a_settled, nxt["size"]).otherwise(a["size"])
    left = (
        F.when(to_a & a_full, nxt["w"] - (a["size"] - a["w"]))
        .when(~to_a & b_full, a["w"] - (nxt["size"] - nxt["w"]))
        .otherwise(a["w"] + nxt["w"])
    )
    settled = F.struct(
        F.when(a_settled, a["id"]).otherwise(nxt["id"]).alias("id"),
        F.when(a_settled, a["size"]).otherwise(nxt["size"]).alias("size"),
        F.when(to_a, a_full).otherwise(b_full).cast("int").alias("up"),
    )
    return F.struct(
        F.struct(still.alias("id"), still_size.alias("size"), left.alias("w")).alias("open"),
        F.concat(state["done"], F.array(settled)).cast(_DONE).alias("done"),
    )


def _fold(entries: DataFrame) -> DataFrame:
    """Rounds ``(rank, bucket, id, size, w)`` within each bucket."""
    grouped = entries.groupBy("rank", "bucket").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("size")).alias("s"), F.xxhash64("id", F.lit(SEED)).alias("h"), "id", "size", "w"))
        ).alias("all")
    )
    bare = F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["w"].alias("w")).cast(_OPEN))
    begun = grouped.withColumn("all", bare)
    start = F.struct(F.element_at("all", 1).alias("open"), F.array().cast(_DONE).alias("done"))
    return begun.select(
        "rank",
        "bucket",
        F.aggregate(F.slice("all", F.lit(2), F.size("all")), start, _step).alias("state"),
    ).select("rank", "bucket", "state.open", "state.done")


def round_copies(entries: DataFrame, buckets: int) -> DataFrame:
    """``(rank, id, size, up)`` with up 0 or 1 from ``(rank, bucket, id, size, w)``.

    ``w / size`` is the probability of up; ``id`` is a struct that no two
    entries share; ``buckets`` is the largest number of buckets of a rank.
    """
    settled = []
    while True:
        folded = keep(_fold(entries), "pivotal")
        settled.append(folded.select("rank", F.explode("done").alias("x")).select("rank", "x.id", "x.size", "x.up"))
        open_ = folded.select("rank", "bucket", "open.id", "open.size", "open.w")
        if buckets <= 1:
            break
        buckets = -(-buckets // FAN)
        entries = open_.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED + 1)), 11) / F.lit(float(1 << 53))
    last = open_.select("rank", "id", "size", (draw < F.col("w") / F.col("size")).cast("int").alias("up"))
    for part in settled:
        last = last.unionByName(part)
    return last


def _copies_each(sources: DataFrame) -> DataFrame:
    """Sources with the whole and fractional part of ``target / source_size``."""
    each = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    near = F.abs(each - F.round(each)) < 1e-12
    return sources.select(
        "source",
        "source_size",
        "target",
        "rank",
        F.when(near, F.round(each)).otherwise(F.floor(each)).cast("int").alias("base"),
        F.when(near, 0.0).otherwise(each - F.floor(each)).alias("fraction"),
        F.ceil(F.col("n_docs") / FAN).alias("n_buckets"),
    )


def _numbered(kinds: DataFrame, most: int) -> DataFrame:
    """A row for each of a kind's equal rows, with its number ``n`` among them."""
    last = F.col("rows") - 1
    if most <= NUMBERED_AT_ONCE:
        return kinds.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begun = kinds.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(NUMBERED_AT_ONCE).cast("long"))))
    return begun.repartition("key", "from").withColumn(
        "n", F.explode(F.sequence("from", F.least(F.col("from") + NUMBERED_AT_ONCE - 1, last)))
    )


def _made_up(copied: DataFrame, max_copies: int) -> DataFrame:
    """``(rank, id, change)``: documents taken more or less often, towards their source's target."""
    missing = (
        copied.groupBy("rank")
        .agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"))
        .select(F.col("rank").alias("r"), (F.col("target") - F.col("taken")).alias("missing"))
    )
    more = F.col("missing") > 0
    may_more, may_less = max_copies - F.col("copies"), F.col("copies")
    able = (
        copied.join(missing, F.col("rank") == F.col("r"))
        .where("size > 0 and missing <> 0")
        .withColumns(
            {
                "toward": F.when(more, may_more).otherwise(may_less).cast("long"),
                "back": F.when(more, may_less).otherwise(may_more).cast("long"),
                "h": F.xxhash64("id", F.lit(SEED + 4)),
                "fits": F.col("size") <= F.abs("missing"),
            }
        )
    )
    one = lambda room: F.struct("h", "id", "size", F.col(room).alias("room"))
    few = able.groupBy(
        "rank", F.floor(F.log2("size")).alias("power"), F.pmod(F.xxhash64("id", F.lit(SEED + 3)), F.lit(SLOTS)).alias("slot")
    ).agg(
        F.first("missing").alias("missing"),
        F.min(F.when(F.col("fits") & (F.col("toward") > 0), one("toward"))).alias("toward"),
        F.min(F.when(F.col("back") > 0, one("back"))).alias("back"),
        F.min(F.when(~F.col("fits") & (F.col("toward") > 0), F.struct("size", "h", "id"))).alias("over"),
    )
    by_size = lambda x: F.array_sort(
        F.collect_list(F.when(F.col(x).isNotNull(), F.struct((-F.col(f"{x}.size")).alias("s"), f"{x}.h", f"{x}.id", f"{x}.room")))
    )
    # at most SLOTS rows of each power of two
    listed = few.groupBy("rank").agg(
        F.first("missing").alias("missing"), by_size("toward").alias("toward"), by_size("back").alias("back"), F.min("over").alias("over")
    )
    chosen = f"array<struct<id:{_ID},times:bigint>>"

    def take(sign: Column):
        def step(state: Column, x: Column) -> Column:
            times = F.least(x["room"], F.floor(state["left"] / -x["s"]))
            entry = F.array(F.struct(x["id"].alias("id"), (sign * times).cast("long").alias("times")))
            return F.struct(
                (state["left"] + x["s"] * times).alias("left"),
                F.when(times > 0, F.concat(state["chosen"], entry)).otherwise(state["chosen"]).cast(chosen).alias("chosen"),
            )

        return step

    sign = F.signum("missing")
    begun = lambda left, first: F.struct(left.alias("left"), first.cast(chosen).alias("chosen"))
    pivot = F.array(F.struct(F.col("over.id").alias("id"), sign.cast("long").alias("times")))
    tried = listed.select(
        "rank",
        # as many as fit, or one too large and others back again, whichever ends nearer
        F.aggregate("toward", begun(F.abs("missing"), F.array()), take(sign)).alias("straight"),
        F.when(
            F.col("over").isNotNull(), F.aggregate("back", begun(F.col("over.size") - F.abs("missing"), pivot), take(-sign))
        ).alias("round"),
    )
    nearer = F.when(F.col("round.left") < F.col("straight.left"), F.col("round.chosen")).otherwise(F.col("straight.chosen"))
    return tried.select("rank", F.explode(nearer).alias("x")).select("rank", "x.id", F.col("x.times").cast("int").alias("change"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """``(rank, id, size, source_size, target, copies)``, one row for each input row."""
    kinds = keep(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col).cast("string")).alias("size"),
            row_key(docs).alias("key"),
        )
        .groupBy("doc_id", "source", "size", "key")
        .agg(F.count(F.lit(1)).alias("rows")),
        "kinds",
    )
    targets = keep(_copies_each(source_targets(kinds, weights, max_copies)), "targets")
    buckets = targets.agg(F.max("n_buckets")).first()[0] or 1
    most = kinds.agg(F.max("rows")).first()[0] or 1
    placed = _numbered(kinds, most).join(
        targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))
    ).withColumn("id", F.struct("doc_id", "key", "n").cast(_ID))
    drawn = (F.col("size") > 0) & (F.col("fraction") > 0)
    bucket = F.pmod(F.xxhash64("id", F.lit(SEED + 2)), "n_buckets")
    entries = placed.where(drawn).select(
        "rank", bucket.alias("bucket"), "id", "size", (F.col("fraction") * F.col("size")).alias("w")
    )
    about = targets.select(F.col("rank").alias("r"), "source_size", "target", "base")
    whole = placed.where(~drawn).select("rank", "id", "size", F.lit(0).alias("up"))
    copied = keep(
        round_copies(entries, buckets)
        .unionByName(whole)
        .join(about, F.col("rank") == F.col("r"))
        .select("rank", "id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base") + F.col("up")).otherwise(0).alias("copies")),
        "copied",
    )
    change = keep(_made_up(copied, max_copies), "made-up").select(F.col("rank").alias("r"), F.col("id").alias("i"), "change")
    return copied.join(change, (F.col("rank") == F.col("r")) & (F.col("id") == F.col("i")), "left").select(
        "rank", "id", "size", "source_size", "target", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)``, one row for each input row.

    ``size`` is the number of words (null text: 0; a very long text is counted
    whole), ``copies`` how often the mix takes the document, ``taken`` their
    words.  Draws are hashes of rows, so reruns agree, however the table is
    split; rows that repeat an id or have none are rounded one by one.  Other
    columns, whatever their names, only tell rows apart.  A null source is a
    source of its own, last in order; a document without words is never
    taken; an empty table gives an empty one.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, max_copies).select(
        "id.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns.

    Rows that are equal in every column stand for one another; together they
    come as often as they are taken in all.  See :func:`mix` for the rest.
    """
    taken = _mixed(docs, id_col, text_col, source_col, weights, max_copies).groupBy("id.doc_id", "id.key").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")
    )
    taken = keep(taken.where("copies > 0"), "taken").select(
        F.col("doc_id").alias("taken_id"), F.col("key").alias("taken_key"), "copies", "rows"
    )
    whole = wrapped(docs).withColumn("key", row_key(docs, "row."))
    same = F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("taken_id")) & (F.col("key") == F.col("taken_key"))
    found = whole.join(taken.where("rows = 1"), same).select("row", "copies")
    if taken.where("rows > 1").head(1):
        equal = whole.join(taken.where("rows > 1"), same).groupBy("taken_id", "taken_key")
        found = found.unionByName(equal.agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies"))
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")

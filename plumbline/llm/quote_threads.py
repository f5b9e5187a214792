"""Quotation linking: conversations from messages that quote one another.

Lines are told apart by their nesting of ``>``; runs of one level are
passages, and passages fall into paragraphs and lines, so that a trimmed
quotation is found too.  Normalised texts are hashed, and a quotation hangs
under the nearest earlier message that wrote its hash.  Writers and askers of
a hash stand in one table in the order of messages, where the last writer is
carried forward, so text that everybody writes and quotes adds no pairs and
is spread over tasks.  Parents found, threads follow by pointer doubling over
the links, and the reply order by counting a thread's messages.

Lines of a message that would read as a quotation or an attribution are
stuffed with a blank when they are sent, which is taken off when they are
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import running
from ..storage import keep

#: Grains of a part, from the largest.
LEVEL, PARAGRAPH, LINE = 2, 1, 0

# possessive, so a mark of any length is matched in a loop and not by recursion
_MARK = r"^(?:>[ \t]?)*+"
_ATTRIBUTION = r"(?:On .* wrote:|.* schrieb am .*:|Le .* a écrit :)\s*$"
#: Lines that are sent with one blank more.
_STUFFED = rf"^(?= *(?:>|{_ATTRIBUTION}))"
_UNSTUFFED = rf"^ (?= *(?:>|{_ATTRIBUTION}))"


def _level(line: Column) -> Column:
    mark = F.regexp_extract(line, _MARK, 0)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def stuffed(text: Column) -> Column:
    """The text with a blank before each line that would read as a quotation or an attribution."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _STUFFED, " ")), "\n")


def normalised(lines: Column) -> Column:
    """Lower-cased lines joined, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.array_join(lines, " ")), r"[\x20\x09-\x0D]+", " "))


def _hash(text: Column) -> Column:
    """Of a passage; null for one without text."""
    return F.when(text != "", F.md5(text.cast("binary")))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``own_text`` (level 0, without attribution lines) and ``passages``.

    ``passages`` is an array of ``(level, hash)`` in the order of the text,
    with the parts of level 0 among them.  ``quoted`` holds the hash of all
    lines of level 1, ``nested`` that of levels 1 and 2 together, ``own``
    that of level 0 and ``own_nested`` that of levels 0 and 1.  ``parts`` is
    an array of ``(level, grain, hash)``: all lines of a level (``LEVEL``),
    its paragraphs (``PARAGRAPH``), which end at blank lines too, and its
    lines (``LINE``), where they have a letter or digit.
    """
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    parsed = messages.withColumn(
        "_lines",
        F.filter(
            F.transform(
                F.filter(lines, lambda x: ~x.rlike("^" + _ATTRIBUTION)),
                lambda x: F.struct(
                    _level(x).alias("level"),
                    F.regexp_replace(F.regexp_replace(x, _MARK, ""), _UNSTUFFED, "").alias("line"),
                ),
            ),
            lambda x: x["line"].isNotNull(),
        ),
    )
    at = F.col("_lines")
    has_text = lambda i: F.get(at, i)["line"].rlike(r"[^\x20\x09-\x0D]")
    new_level = lambda i: (i == 0) | (F.get(at, i)["level"] != F.get(at, i - 1)["level"])
    starts = lambda begins: F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), begins)
    ends = lambda column: F.concat(F.slice(column, F.lit(2), F.size(column)), F.array(F.size("_lines")))
    parsed = parsed.withColumns(
        {"_starts": starts(new_level), "_begins": starts(lambda i: new_level(i) | (has_text(i) & ~has_text(i - 1)))}
    ).withColumns({"_ends": ends("_starts"), "_stops": ends("_begins")})
    between = lambda s, e: normalised(
        F.transform(F.slice(at, s + 1, F.greatest(e - s, F.lit(0))), lambda x: x["line"])
    )
    part = lambda level, grain, text: F.struct(
        level.alias("level"), F.lit(grain).alias("grain"), F.when(text.rlike(r"[\p{L}\p{N}]"), _hash(text)).alias("hash")
    )
    text_of = lambda *levels: F.transform(
        F.filter(at, lambda x: x["level"].isin(*levels)), lambda x: x["line"]
    )
    pair = lambda a, b: F.when(
        normalised(text_of(b)) != "",
        _hash(F.concat_ws("\x00", normalised(text_of(a)), normalised(text_of(b)))),
    )
    return parsed.withColumns(
        {
            "own_text": F.rtrim(F.array_join(text_of(0), "\n"), F.lit(" \t\n")),
            "own": _hash(normalised(text_of(0))),
            "own_nested": pair(0, 1),
            "quoted": _hash(normalised(text_of(1))),
            "nested": pair(1, 2),
            "passages": F.zip_with(
                "_starts",
                "_ends",
                lambda s, e: F.struct(F.get(at, s)["level"].alias("level"), _hash(between(s, e)).alias("hash")),
            ),
            "parts": F.filter(
                F.array_distinct(
                    F.concat(
                        F.transform(
                            F.array_distinct(F.transform(at, lambda x: x["level"])),
                            lambda level: part(
                                level,
                                LEVEL,
                                normalised(
                                    F.transform(F.filter(at, lambda x: x["level"] == level), lambda x: x["line"])
                                ),
                            ),
                        ),
                        F.zip_with("_begins", "_stops", lambda s, e: part(F.get(at, s)["level"], PARAGRAPH, between(s, e))),
                        F.transform(at, lambda x: part(x["level"], LINE, normalised(F.array(x["line"])))),
                    )
                ),
                lambda x: x["hash"].isNotNull(),
            ),
        }
    ).drop("_lines", "_starts", "_ends", "_begins", "_stops")


def _under(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _depths(links: DataFrame) -> DataFrame:
    """``(scope, msg, root, depth)`` from ``(scope, msg, parent)``; parents precede their replies.

    Pointers double their reach each round.  A message whose pointer has met
    one that is settled is settled too, and only the others go on, so a long
    thread costs rounds for its own messages alone.
    """
    settled = [
        links.where("parent is null").select(
            "scope", "msg", F.col("msg").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("final")
        )
    ]
    going = links.where("parent is not null").select(
        "scope", "msg", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("final")
    )
    while True:
        above = _under([*settled, going]).select(
            F.col("scope").alias("s"),
            F.col("msg").alias("m"),
            F.col("root").alias("r"),
            F.col("depth").alias("d"),
            F.col("final").alias("f"),
        )
        moved = keep(
            going.join(above, F.col("scope").eqNullSafe(F.col("s")) & (F.col("root") == F.col("m"))).select(
                "scope", "msg", F.col("r").alias("root"), (F.col("depth") + F.col("d")).alias("depth"), F.col("f").alias("final")
            ),
            "thread",
        )
        settled.append(moved.where("final"))
        going = moved.where("not final")
        if not going.head(1):
            return _under(settled).drop("final")


#: Values of a message's place that one stretch of a thread counts over.
STRETCH = 4096


def _reply_order(placed: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the 0-based place in the thread: by message, since replies come after what they answer.

    Counted stretch by stretch, so a thread of any length is spread over tasks.
    """
    stretch = placed.withColumn("stretch", F.floor(F.col("msg") / STRETCH))
    sizes = stretch.groupBy("scope", "root", "stretch").agg(F.count(F.lit(1)).alias("held"))
    before = running(sizes, ["scope", "root"], ["stretch"], F.col("held"), "before", "sum", spread=True, current=False).select(
        F.col("scope").alias("s"), F.col("root").alias("r"), F.col("stretch").alias("t"), F.coalesce("before", F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("scope", "root", "stretch").orderBy("msg")) - 1
    same = F.col("scope").eqNullSafe(F.col("s")) & (F.col("root") == F.col("r")) & (F.col("stretch") == F.col("t"))
    return stretch.withColumn("inside", inside).join(before, same).withColumn("ordinal", F.col("before") + F.col("inside")).select(
        *placed.columns, "ordinal"
    )


def _nearest(written: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with ``writer``: the latest earlier message of the scope that wrote the hash."""
    rows = asked.withColumns({"writes": F.lit(0), "own": F.lit(None).cast("long")}).unionByName(
        written.withColumns({"writes": F.lit(1), "own": F.col("msg")}), allowMissingColumns=True
    )
    # at one message askers come first, so a message doesn't answer itself
    filled = running(rows, ["scope", "hash", "whole"], ["msg", "writes"], F.col("own"), "writer", "last", spread=True)
    return filled.where("writes = 0 and writer is not null").select(*asked.columns, "writer")


def link_quotations(
    messages: DataFrame, scope_col: str = "conv_id", order_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """``(scope, msg, parent, root, depth, ordinal, own_text, n_passages)``, one row for each message.

    ``parent`` is the message that the quotation comes from: one of the same
    scope whose own text and quotation equal the quoted and nested text, else
    whose own text equals the quoted text, else which wrote one of the quoted
    passages; else of which the quotation is a part: which wrote, among other
    text, all of the quoted text, else a passage, a paragraph or a line of
    it.  Where nothing of level 1 is found, the deeper levels are asked in
    the same way, one after the other, so a reply whose direct parent is
    missing hangs under the message quoted deeper.  Only earlier messages
    count, and of several candidates the latest is the parent, so of messages
    that say the same the nearest is answered.

    ``root`` starts the thread, ``depth`` counts the replies to it,
    ``ordinal`` is the message's place in the thread and ``own_text`` its
    text without quotations.  Null or empty texts quote nothing and are
    quoted by nothing; very long texts, lines and marks are read whole; of
    rows that repeat a scope and order the largest text counts; a null scope
    is a scope of its own; a null order has no place and is left out; other
    columns, whatever their names, are not read; an empty table gives an
    empty one.
    """
    unique = (
        messages.select(
            F.col(scope_col).alias("scope"), F.col(order_col).cast("long").alias("msg"), F.col(text_col).cast("string").alias("text")
        )
        .where("msg is not null")
        .groupBy("scope", "msg")
        .agg(F.max("text").alias("text"))
    )
    parsed = keep(parse_quotes(unique).drop("text"), "parsed")
    passages = lambda level: F.transform(
        F.filter("passages", lambda p: p["level"] == level), lambda p: p["hash"]
    )
    written = (
        parsed.select(
            "scope",
            "msg",
            F.explode(
                F.concat(
                    F.transform(
                        F.array_distinct(F.concat(F.array("own", "own_nested"), passages(0))),
                        lambda h: F.struct(F.lit(True).alias("whole"), h.alias("hash")),
                    ),
                    F.transform(
                        F.filter("parts", lambda p: (p["level"] == 0) & (p["grain"] < LEVEL)),
                        lambda p: F.struct(F.lit(False).alias("whole"), p["hash"].alias("hash")),
                    ),
                )
            ).alias("key"),
        )
        .select("scope", "msg", "key.whole", "key.hash")
        .where("hash is not null")
        .distinct()
    )
    keyed = lambda level, rank, column: F.struct(
        level.cast("int").alias("level"), F.lit(rank).cast("int").alias("rank"), column.alias("hash")
    )
    asked = (
        parsed.select(
            "scope",
            "msg",
            F.explode(
                F.concat(
                    F.array(keyed(F.lit(1), 5, F.col("nested")), keyed(F.lit(1), 4, F.col("quoted"))),
                    F.transform(
                        F.filter("passages", lambda p: p["level"] > 0), lambda p: keyed(p["level"], 3, p["hash"])
                    ),
                    F.transform(
                        F.filter("parts", lambda p: p["level"] > 0),
                        lambda p: F.struct(
                            p["level"].cast("int").alias("level"),
                            F.when(p["grain"] == LEVEL, 4).otherwise(p["grain"]).cast("int").alias("rank"),
                            p["hash"].alias("hash"),
                        ),
                    ),
                )
            ).alias("key"),
        )
        .select("scope", "msg", "key.level", "key.rank", "key.hash")
        .where("hash is not null")
        .distinct()
        .withColumn("whole", F.explode(F.array(F.lit(True), F.lit(False))))
    )
    # whole messages and passages that quoted text or passages equal come before all that are parts
    first = F.col("whole") & (F.col("rank") >= 3)
    parents = (
        _nearest(written, asked)
        .groupBy("scope", "msg")
        .agg(F.max(F.struct(-F.col("level"), first, "rank", "whole", "writer")).alias("best"))
        .select(F.col("scope").alias("s"), F.col("msg").alias("m"), F.col("best.writer").alias("parent"))
    )
    linked = keep(
        parsed.join(parents, F.col("scope").eqNullSafe(F.col("s")) & (F.col("msg") == F.col("m")), "left").select(
            "scope", "msg", "parent", "own_text", F.size("passages").alias("n_passages")
        ),
        "linked",
    )
    placed = _reply_order(_depths(linked)).select(F.col("scope").alias("s"), F.col("msg").alias("m"), "root", "depth", "ordinal")
    return linked.join(placed, F.col("scope").eqNullSafe(F.col("s")) & (F.col("msg") == F.col("m"))).select(
        "scope", "msg", "parent", "root", "depth", "ordinal", "own_text", "n_passages"
    )


def as_mails(conversations: DataFrame) -> DataFrame:
    """Conversations as a mail client would send them: each turn over the two before it, quoted.

    The turns before one are those of the next smaller numbers, gaps or not.
    They are found by numbers alone, and texts join on them, so a very long
    conversation is spread like any other rows.  Of repeated turns the
    largest text counts.
    """
    turns = conversations.where("turn is not null").groupBy("conv_id", F.col("turn").cast("long").alias("turn")).agg(F.max("text").alias("text"))
    numbers = running(turns.select("conv_id", "turn"), ["conv_id"], ["turn"], F.col("turn"), "one", spread=True, current=False)
    same = lambda column: F.col("conv_id").eqNullSafe(F.col("c")) & (F.col(column) == F.col("t"))
    two = numbers.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("one").alias("two"))
    numbers = keep(numbers.join(two, same("one"), "left").select("conv_id", "turn", "one", "two"), "turns")
    text_of = lambda name: turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias(name))
    joined = numbers
    for number, name in (("turn", "text"), ("one", "back1"), ("two", "back2")):
        joined = joined.join(text_of(name), same(number), "left").drop("c", "t")
    quote = lambda column, mark: F.when(
        F.col(column).isNotNull(), F.concat(F.lit("\n" + mark), F.regexp_replace(stuffed(F.col(column)), "\n", "\n" + mark))
    ).otherwise("")
    return joined.select(
        "conv_id",
        "turn",
        F.concat(stuffed(F.coalesce("text", F.lit(""))), quote("back1", "> "), quote("back2", ">> ")).alias("text"),
    )

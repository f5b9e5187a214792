"""Quality rules: base counts and divergence from language references.

Every count is a DataFrame expression over the row's own text, so the tables
of texts are never shuffled.  The divergence rule compares a document with
the reference of its language, which is summed over the whole table:

* the histogram of character classes, and
* the histogram of the language's common words, all other words being one
  more bin.  Common are words that make up one in ``COMMON_PART`` of all words
  of the language at least, of which there can be no more than that,

each by Jensen-Shannon distance (base 2, so 0 to 1).  A histogram over too
few observations says nothing, so short ones are not judged; nor is a
document whose language is unknown or has too small a reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep, wrapped

#: Regular expressions of the character classes, in the order in which they are taken out of the text.
CLASSES = (
    ("lower", r"\p{Ll}+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", r"\p{Lu}+"),
    ("symbol", r"[#*$%&|<>]+"),
    ("punct", r"\p{P}+"),
    ("digit", r"\p{N}+"),
)
SEPARATORS = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Characters and words below which a histogram isn't judged.
MIN_CHARS = 200
MIN_JUDGED_WORDS = 100
#: Characters and words below which a language has no reference.
MIN_REFERENCE_CHARS = 20_000
MIN_REFERENCE_WORDS = 2_000
#: Largest distances kept.  A sample of n words strays from its own source by about
#: 1 / sqrt(n), so the limit for words falls with n to its floor.
MAX_CLASS_DISTANCE = 0.3
MAX_COMMON_DISTANCE = 0.2
COMMON_SLACK = 1.7

#: A common word's least part of its language's words.
COMMON_PART = 500
#: References up to which they are broadcast.
BROADCAST_LANGS = 1000
#: Common words of all languages up to which they are constants of the plan; more are joined.
LITERAL_WORDS = 50_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _bare(word: Column) -> Column:
    """A word as it is told common: lower case, without the stops after it."""
    return F.rtrim(F.lower(word), F.lit(".,;:!?"))


def _language(lang: Column) -> Column:
    return F.when(F.trim(lang.cast("string")) != "", lang.cast("string"))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, w, share)``: words of at least one in ``COMMON_PART`` of their language's words.

    Counted over all documents of each language with ``MIN_REFERENCE_WORDS``
    words; counts are summed where texts are read before they are shuffled.
    """
    counted = (
        docs.select(_language(F.col(lang_col)).alias("lang"), F.explode(_words(F.col(text_col).cast("string"))).alias("w"))
        .where("lang is not null")
        .groupBy("lang", _bare(F.col("w")).alias("w"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counted = keep(counted, "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("c").alias("words")).where(F.col("words") >= MIN_REFERENCE_WORDS)
    return (
        counted.join(totals.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l"))
        .where(F.col("c") * COMMON_PART >= F.col("words"))
        .select("lang", "w", (F.col("c") / F.col("words")).alias("share"))
    )


def _array_sum(array: Column, kind: str = "long") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: a + x)


def measure(docs: DataFrame, common: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds the column ``_m``, a struct of everything the rules look at.

    A null text counts as one without words.  ``_m.lang`` is the language of
    the reference: ``lang_col`` as it stands, null if blank.  ``common`` are
    the words of :func:`common_words`; ``_m.common`` counts those of the
    document's own language, among others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = _language(F.col(lang_col))
    columns = docs.columns
    literal = [r.w for r in common.select("w").distinct().limit(LITERAL_WORDS + 1).collect()]
    if len(literal) <= LITERAL_WORDS:
        is_common = lambda w: w.isin(*literal) if literal else F.lit(False)
    else:
        own = common.groupBy(F.col("lang").alias("_own_lang")).agg(F.collect_list("w").alias("_own_words"))
        docs = docs.join(own, lang == F.col("_own_lang"), "left")  # a text beside its language's words
        is_common = lambda w: F.coalesce(F.array_contains("_own_words", w), F.lit(False))
    staged = docs.withColumns(
        {
            "_t0": text,
            "_words": _words(text),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    for k, (_, pattern) in enumerate(CLASSES):
        staged = staged.withColumn(f"_t{k + 1}", F.regexp_replace(f"_t{k}", pattern, ""))
    n = F.size("_words")
    staged = staged.withColumns(
        {
            "_windows": F.when(
                n >= WINDOW,
                F.transform(
                    F.sequence(F.lit(1), n - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
                ),
            ),
            "_common": F.array_sort(
                F.filter(F.transform("_words", _bare), is_common)
            ),
        }
    )
    staged = staged.withColumns(
        {
            "_pairs": F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.array_sort(
                    F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
                ),
            ),
            "_kinds": F.array_distinct("_common"),
        }
    )
    pairs = F.col("_pairs")
    twice = F.filter(
        pairs,
        lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]),
    )
    staged = staged.withColumns(
        {
            "_at": F.array_sort(F.transform(F.filter(twice, lambda x: x.isNotNull()), lambda x: x["i"])),
            "_first": F.transform("_kinds", lambda w: F.array_position("_common", w)),
        }
    )
    at, m = F.col("_at"), F.size("_at")
    gaps = F.zip_with(
        F.slice(at, F.lit(1), m - 1), F.slice(at, F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))
    )
    nexts = F.concat(
        F.slice("_first", F.lit(2), F.greatest(F.size("_first") - 1, F.lit(0))),
        F.array((F.size("_common") + 1).cast("long")),
    )
    length = [F.char_length(f"_t{k}") for k in range(len(CLASSES) + 1)]
    counts = [(length[k] - length[k + 1]).cast("long") for k in range(len(CLASSES))] + [length[-1].cast("long")]
    names = [name for name, _ in CLASSES]
    return staged.withColumn(
        "_m",
        F.struct(
            lang.alias("lang"),
            n.cast("long").alias("n_words"),
            (length[0].cast("long") - counts[names.index("space")]).alias("word_chars"),
            counts[names.index("symbol")].alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(m > 0, _array_sum(gaps.cast("array<long>")) + WINDOW)
            .otherwise(0)
            .cast("long")
            .alias("n_repeat_words"),
            F.array(*counts).alias("classes"),
            F.filter(
                F.zip_with(
                    "_kinds",
                    F.zip_with("_first", nexts, lambda a, b: b - a),
                    lambda w, c: F.struct(w.alias("w"), c.alias("c")),
                ),
                lambda x: x["w"].isNotNull(),
            ).alias("common"),
        ),
    ).select(*[F.col(f"`{c}`") for c in columns], "_m")


def references(measured: DataFrame, common: DataFrame) -> DataFrame:
    """One row for each language with a reference: ``(lang, ref_classes, ref_common)``.

    Shares over all documents of the language, each value of the language
    column for itself.  Documents without a language are in no reference.
    """
    measured = measured.where("_m.lang is not null")
    width = len(CLASSES) + 1
    classes = measured.groupBy(F.col("_m.lang").alias("lang")).agg(
        *[F.sum(F.col("_m.classes")[k]).alias(f"c{k}") for k in range(width)]
    )
    chars = sum(F.col(f"c{k}") for k in range(width))
    classes = classes.where(chars >= MIN_REFERENCE_CHARS).select(
        "lang", F.array(*[F.col(f"c{k}") / chars for k in range(width)]).alias("ref_classes")
    )
    # at most COMMON_PART words a language
    shares = common.groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "share")))).alias("ref_common"))
    return classes.join(shares, "lang", "left").select("lang", "ref_classes", "ref_common")


def _distance(shares: Column, seen: Column) -> Column:
    """Jensen-Shannon distance from ``(p, q)`` pairs with p > 0; ``seen`` is their sum of q."""
    inside = F.aggregate(
        shares,
        F.lit(0.0),
        lambda a, x: a
        + 0.5 * x["p"] * F.log2(2 * x["p"] / (x["p"] + x["q"]))
        + F.when(x["q"] > 0, 0.5 * x["q"] * F.log2(2 * x["q"] / (x["p"] + x["q"]))).otherwise(0.0),
    )
    return F.sqrt(F.greatest(inside + 0.5 * F.greatest(1 - seen, F.lit(0.0)), F.lit(0.0)))


def judge(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``class_distance``, ``common_distance``, ``base_failed`` and ``kept``.

    A distance is null where it isn't judged.  ``refs`` is counted, and
    broadcast up to ``BROADCAST_LANGS`` rows.
    """
    m = F.col("_m")
    chars = _array_sum(m["classes"])
    named = refs.withColumnRenamed("lang", "_lang")
    if named.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        named = F.broadcast(named)
    judged = measured.join(named, m["lang"] == F.col("_lang"), "left").withColumns(
        {
            "_chars": chars,
            "_held": F.filter(m["common"], lambda x: F.map_contains_key("ref_common", x["w"])),
            "_ref_rest": 1 - _array_sum(F.map_values("ref_common"), "double"),
        }
    )
    judged = judged.withColumn("_rest", m["n_words"] - _array_sum(F.transform("_held", lambda x: x["c"])))
    judged = judged.withColumns(
        {
            "_class_shares": F.filter(
                F.zip_with(
                    m["classes"],
                    F.col("ref_classes"),
                    lambda c, q: F.struct(F.try_divide(c, F.col("_chars")).alias("p"), q.alias("q")),
                ),
                lambda x: x["p"] > 0,
            ),
            "_common_shares": F.filter(
                F.concat(
                    F.transform(
                        "_held",
                        lambda x: F.struct(
                            F.try_divide(x["c"], m["n_words"]).alias("p"),
                            F.try_element_at("ref_common", x["w"]).alias("q"),
                        ),
                    ),
                    F.array(F.struct(F.try_divide("_rest", m["n_words"]).alias("p"), F.col("_ref_rest").alias("q"))),
                ),
                lambda x: x["p"] > 0,
            ),
        }
    )
    seen = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["q"])
    judged = judged.withColumns(
        {
            "class_distance": F.when(
                (F.col("_chars") >= MIN_CHARS) & F.col("ref_classes").isNotNull(),
                _distance(F.col("_class_shares"), seen("_class_shares")),
            ),
            "common_distance": F.when(
                (m["n_words"] >= MIN_JUDGED_WORDS) & F.col("ref_common").isNotNull(),
                _distance(F.col("_common_shares"), seen("_common_shares")),
            ),
            "base_failed": (m["n_words"] < MIN_WORDS)
            | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
        }
    )
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (
        F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON_DISTANCE + F.try_divide(F.lit(COMMON_SLACK), F.sqrt(m["n_words"]))
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~diverges)


def quality_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The counts and verdicts of every row; two passes over the texts, then their small measures.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, common_distance)``.  Rows that repeat
    are returned as often as they occur and count so often in the references;
    null ids are carried through; a null or empty text has no words and fails;
    a very long text is measured whole; a null language, or one with too
    small a reference, is judged by the base rules alone; other columns,
    whatever their names, are not read.  An empty table gives an empty one.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    common = keep(common_words(slim), "common-words")
    measured = keep(measure(slim, common).select("doc_id", "_m"), "quality-measures")
    return judge(measured, keep(references(measured, common), "quality-references")).select(
        "doc_id",
        *[F.col(f"_m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        "class_distance",
        "common_distance",
    )


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The edge cases are those of :func:`quality_report`, whose verdicts these
    are.  Texts are measured once: rows are written beside their measures and
    read again for the verdict.  They aren't shuffled unless there are more
    than ``BROADCAST_LANGS`` references.
    """
    slim = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    common = keep(common_words(slim), "common-words")
    measured = keep(measure(wrapped(docs), common, f"row.`{text_col}`", f"row.`{lang_col}`"), "quality-measures")
    return judge(measured, keep(references(measured, common), "quality-references")).where("kept").select("row.*")

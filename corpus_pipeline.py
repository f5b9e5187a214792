"""The corpus pipeline: stages over ``documents``, each one's table the next one's input.

Quality classifier, quality rules, near-duplicates, mixing, packing.  A stage
judges rows, not ids: rows that repeat an id, or have none, stay or go by
their own texts, and each stage but the last returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.mixing import mixed_documents
from plumbline.llm.packing import pack
from plumbline.llm.quality_classifier import quality_accepted
from plumbline.llm.quality_rules import quality_filter
from plumbline.llm.simhash import one_of_each
from plumbline.shipping import bound_batches, ship
from plumbline.storage import drop, keep, scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, accepts.

    Null and empty texts are scored like any other.  Labels find texts by id;
    an id with several texts teaches their mean.  An empty table gives an
    empty one.
    """
    ship(spark)
    bound_batches(spark)
    return quality_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text has too few words and goes; a null language is
    judged by the base rules alone.  References are those of the documents
    that reach this stage.  An empty table gives an empty one.
    """
    return quality_filter(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id, nulls last.

    Of rows that are equal in every column one stays.  An empty table gives an
    empty one.
    """
    ship(spark)
    bound_batches(spark)
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken.

    A null source is a source of its own; documents without words are never
    taken; rows without an id are taken like any other.  An empty table gives
    an empty one.
    """
    return mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids.

    A document that the mix takes several times is packed so often; null ids
    are carried through.  An empty table gives an empty one.
    """
    ship(spark)
    bound_batches(spark)
    return pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can express neither the learnt weights nor the hashes, components and
#: rounding; tests/llm/test_pipeline.py holds every stage, and the whole,
#: against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's table is written and read again.

    What a stage keeps beside its table is deleted when that is written, and
    the table when the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        with scratch() as tables:
            after = keep(stage(spark, docs, sf_dir), name)
            tables.remove(after)
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

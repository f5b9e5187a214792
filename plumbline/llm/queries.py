"""The registered queries of the pipeline's operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .arc_convert import archive_pages
from .inner_topk import top_inner_products
from .license_scan import license_templates, scan_templates
from .mixing import mix
from .packing import pack
from .quality_classifier import quality_scores
from .quality_rules import quality_report
from .quote_threads import as_mails, link_quotations
from .sharding import read_shards, write_shards
from .simhash import near_duplicates
from ..storage import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents")).drop("class_distance", "common_distance")


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = as_mails(_table(spark, sf_dir, "conversations"))
    return link_quotations(mails).select(
        F.col("scope").alias("conv_id"),
        F.col("msg").alias("turn"),
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"),
        "depth",
        F.col("ordinal").alias("reply_ordinal"),
        F.md5(F.col("own_text").cast("binary")).alias("own_text_md5"),
    )


def op5_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark:"), F.col("item_id")).alias("template"), "text"
    )
    return scan_templates(_table(spark, sf_dir, "documents"), license_templates(spark).unionByName(passages))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op8_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sharded")
    write_shards(_table(spark, sf_dir, "documents"), path)
    rows = read_shards(spark, path).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("bytes"),
        "shard_id",
        F.length("shard_id").alias("depth"),
    )
    sizes = rows.groupBy("shard_id").agg(F.sum("bytes").alias("shard_bytes"))
    return rows.join(sizes, "shard_id").select("doc_id", "bytes", "shard_id", "depth", "shard_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_gray": op1_simhash_gray,
    "op2_distribution_divergence": op2_distribution_divergence,
    "op3_bradley_terry": op3_bradley_terry,
    "op4_quotation_linking": op4_quotation_linking,
    "op5_license_windows": op5_license_windows,
    "op6_pivotal_mix": op6_pivotal_mix,
    "op7_arc_to_warc": op7_arc_to_warc,
    "op8_norm_sorted_topk": op8_norm_sorted_topk,
    "op9_hierarchical_packing": op9_hierarchical_packing,
    "op10_extendible_hashing": op10_extendible_hashing,
}

ORACLE: dict[str, str] = {
    "op2_distribution_divergence": oracles.quality_rules(),
    "op4_quotation_linking": oracles.threads(),
    "op7_arc_to_warc": oracles.archive_pages(),
    "op8_norm_sorted_topk": oracles.top_inner_products(),
    "op10_extendible_hashing": oracles.shards(),
}

"""What an executor's Python workers and its Arrow batches may hold in the pipeline."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumbline.llm import mixing, packing

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _texts(count):
    rng = random.Random(5)
    common = ["Und", "die", "naïve", "it's", "x--", "...", "ИЯ,", "<|pad|>"]
    return [
        " ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(10**6)}{rng.choice(['', ',', '!?'])}" for _ in range(60)).encode()
        for _ in range(count)
    ]


def test_cached_words_stay_bounded_and_ids_the_same(monkeypatch):
    path, texts = packing.default_tokenizer(), _texts(300)
    monkeypatch.setattr(packing, "GROUP_BYTES", 2000)
    expected = [ids.tolist() for ids in packing.WordTokenizer(path).encode(texts)]
    monkeypatch.setattr(packing, "CACHED_WORDS", 400)
    small = packing.WordTokenizer(path)
    for _ in range(2):
        assert [ids.tolist() for ids in small.encode(texts)] == expected
        assert len(small.words.numbers) < 1000 and len(small.parts.numbers) < 1000
        assert b"die" in small.words.numbers  # used most
        small.forget(0)
        assert not small.words.numbers and not small.parts.numbers


def test_worker_keeps_few_words_after_a_task(monkeypatch):
    path, texts = packing.default_tokenizer(), _texts(200)
    monkeypatch.setattr(packing.WordTokenizer, "_loaded", {})
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([t.decode() for t in texts])], ["doc_id", "text"])
    first = [b.to_pylist() for b in packing._pack_batches(path, packing.TIERS, True)([batch])]
    held = packing.WordTokenizer.load(path)
    assert 0 < len(held.words.numbers) <= 50 and len(held.parts.numbers) <= 50
    assert [b.to_pylist() for b in packing._pack_batches(path, packing.TIERS, True)([batch])] == first


def test_stages_bound_batches_by_bytes(spark):
    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    spark.conf.unset(KEY)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    try:
        cp.pack_windows(spark, docs, "/root/testdata/sf0.001")
        long_ = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") == 7, 9 << 20).otherwise(1 << 20)).alias("t"))
        found = long_.mapInArrow(measured, "rows long, bytes long").collect()
        assert sum(r.rows for r in found) == 24
        assert max(r.bytes for r in found) < 14 << 20  # the longest row and what stood before it
        spark.conf.set(KEY, "12345678")
        cp.drop_copies(spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(KEY) == "12345678"
    finally:
        spark.conf.unset(KEY)


def test_source_ranks_need_no_python_workers(spark):
    sources = spark.sql("select * from values ('b', 2L), ('a', 1L), (null, 3L) as t(source, size)")
    ranked = mixing._ranked(sources)
    assert "ExistingRDD" not in ranked._jdf.queryExecution().toString()
    assert {r.source: r.rank for r in ranked.collect()} == {"a": 0, "b": 1, None: 2}
    assert mixing._ranked(sources.where("false")).count() == 0

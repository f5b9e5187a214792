from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import mixing, packing, sharding

DOCS = "doc_id long, text string, source string, size long, h long, copies int, row string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "r") for r in rows], DOCS)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        share = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * share for s in names}
        capped |= over


@pytest.fixture(scope="module")
def mix_rows():
    rng = random.Random(1)
    rows = []
    for k in range(1500):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None])
        rows.append((k, "w " * rng.choice([0, 1, 5, 20, 300]), source))
    return [*rows, (2000, "w " * 4, "tiny"), (2001, None, "tiny"), (2002, "w " * 20_000, "a"), (None, "w w", "b"), (5, "w w w", "b"), (2003, "", "empty")]


@pytest.mark.parametrize("fan", [8, 256])
def test_mix(spark, mix_rows, fan, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", fan)
    found = mixing.mix(table(spark, mix_rows)).collect()
    assert len(found) == len(mix_rows)
    sizes, source_of, lengths = defaultdict(int), defaultdict(list), defaultdict(list)
    for i, t, s in mix_rows:
        n = len((t or "").split())
        sizes[s] += n
        lengths[s].append(n)
        source_of[i, n].append(s)
    targets = brute_targets(sizes)
    taken, target = defaultdict(int), {}
    for r in found:
        source = source_of[r.doc_id, r["size"]].pop()
        assert r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[source] += r.taken
        target[source] = r.target
    for source in sizes:
        near = max(sorted(lengths[source])[len(lengths[source]) // 2], 0.01 * target[source])
        assert abs(taken[source] - target[source]) <= near, source
    again = mixing.mix(table(spark, mix_rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_small_sources_of_large_documents_meet_their_targets(spark):
    rng = random.Random(9)
    rows = [(k, "w " * int(40 + rng.paretovariate(0.9) * 100), f"s{k % 20:02}") for k in range(800)]
    taken, target, size = defaultdict(int), {}, defaultdict(list)
    source_of = {i: s for i, _, s in rows}
    for r in mixing.mix(table(spark, rows)).collect():
        taken[source_of[r.doc_id]] += r.taken
        target[source_of[r.doc_id]] = r.target
        size[source_of[r.doc_id]].append(r["size"])
    for s, want in target.items():
        assert abs(taken[s] - want) <= max(0.01 * want, sorted(size[s])[len(size[s]) // 2]), s


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 8)
    monkeypatch.setattr(mixing, "NUMBERED_AT_ONCE", 16)
    rows = [(None, "a b c", "s")] * 300 + [(7, "x y", "s")] * 50 + [(7, "z", "t")] * 3 + [(8, "w " * 40, "t")]
    docs = table(spark, rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    taken = sum(r.taken for r in found if r.source_size == 1000)
    assert abs(taken - next(r.target for r in found if r.source_size == 1000)) <= 3
    mixed = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        mixed[r.doc_id, r.text] += 1
    expected = defaultdict(int)
    for r in found:
        text = {3: "a b c", 2: "x y", 1: "z", 40: "w " * 40}[r["size"]]
        expected[r.doc_id, text] += r.copies
    assert dict(mixed) == {k: v for k, v in expected.items() if v}


def test_mixed_documents(spark, mix_rows):
    docs = table(spark, mix_rows)
    expected = defaultdict(int)
    for r in mixing.mix(docs).collect():
        expected[r.doc_id, r["size"]] += r.copies
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = defaultdict(int)
    for r in mixed.collect():
        found[r.doc_id, len((r.text or "").split())] += 1
    assert dict(found) == {k: v for k, v in expected.items() if v}


def test_expectation_is_kept(spark):
    """Over many sources alike, rounding takes a document as often as its fraction says."""
    shape = [(10, 4.0), (30, 12.0), (7, 2.8), (200, 80.0), (55, 22.0)]
    rows = [(rank, k % 2, (rank * 10 + k, 0, 0), size, w) for rank in range(1500) for k, (size, w) in enumerate(shape)]
    entries = spark.createDataFrame(rows, f"rank long, bucket long, id {mixing._ID}, size long, w double")
    found = mixing.round_copies(entries, 2).select("rank", "id.doc_id", "size", "up").collect()
    assert len(found) == len(rows)
    ups, words = defaultdict(int), defaultdict(int)
    for r in found:
        ups[r["size"]] += r.up
        words[r.rank] += r.up * r["size"]
    for size, _ in shape:
        assert abs(ups[size] / 1500 - 0.4) < 0.05, size
    assert all(abs(n - sum(w for _, w in shape)) <= 200 for n in words.values())


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert packing.pack(none).count() == 0 and sharding.assign_shards(none).count() == 0


TEXTS = [None, "", "  \n", "Hello, world! It's <|endoftext|> fine…", "Ünï x²y 12,345.67 'tis ABC's\x0b\x0cé.", "<|STARTOFTEXT|> A", "word&&& WORD!! don't.", "a b\x1fc e\x85f", "é İ ΑΣ"]


def test_tokens_equal_whole_text_encoding():
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    for text in TEXTS:
        ids = next(tokenizer.encode([None if text is None else text.encode()]))
        assert ids.tolist() == [*tokenizer.model.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


ALPHABET = st.sampled_from(["a", "B", "é", "É", "ß", "ñ", "ŀ", "İ", "ı", "Σ", "σ", "1", "²", "…", "'", "'s", ".", "!?", "<|", "|>", "_", " ", "\n", "的", "\u0301", "endoftext", "<|endoftext|>", "'ll", "Ⅷ", "ª", "\u0085", "🙂"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=25).map("".join))
def test_any_text_is_encoded_as_a_whole_would_be(text):
    tokenizer = packing.WordTokenizer.load(packing.default_tokenizer())
    ids = next(tokenizer.encode([text.encode()]))
    assert ids.tolist() == [*tokenizer.model.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_groups_and_forgetting_change_nothing(monkeypatch):
    texts = [t.encode() if t else t for t in TEXTS] + [(f"w{k} Wörter, é{k}." * 3).encode() for k in range(50)] + [b"x" * 300_000]
    expected = [ids.tolist() for ids in packing.WordTokenizer(packing.default_tokenizer()).encode(texts)]
    monkeypatch.setattr(packing, "GROUP_BYTES", 40)
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    assert [ids.tolist() for ids in packing.WordTokenizer(packing.default_tokenizer()).encode(texts)] == expected


@pytest.mark.parametrize("buffer", [1 << 20, 3000])
def test_packing_round_trip(spark, buffer):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta.", "Gamma", "don't"]) for _ in range(int(rng.paretovariate(0.8) * 20) % 9000)), "s") for k in range(120)]
    rows += [(1000 + k, t, None) for k, t in enumerate(TEXTS)] + [(None, "null id", "s"), (3, "again", "s")]
    path, before = packing.default_tokenizer(), packing.BUFFER_IDS
    tokenizer = packing.WordTokenizer(path)
    packers = []
    packing.BUFFER_IDS = buffer
    try:
        out, packer = [], packing._Packer(5, packing.TIERS)
        for (i, _, _), ids in zip(rows, tokenizer.encode([None if t is None else t.encode() for _, t, _ in rows]), strict=True):
            if packer.add(i, ids):
                out += packer.flush().to_pylist()
        out += packer.flush(last=True).to_pylist()
    finally:
        packing.BUFFER_IDS = before
    check_pieces(out, rows, tokenizer)
    if buffer == before:
        packers = [r.asDict() for r in packing.pack(table(spark, rows)).collect()]
        check_pieces(packers, rows, tokenizer)


def check_pieces(out, rows, tokenizer):
    ids_of = defaultdict(list)
    for (i, t, _), ids in zip(rows, tokenizer.encode([None if r[1] is None else r[1].encode() for r in rows]), strict=True):
        ids_of[i, len(ids)].append(ids)
    seen, sequences = defaultdict(int), defaultdict(list)
    for p in out:
        options = ids_of[p["doc_id"], p["doc_tokens"]]
        assert any(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in options)
        seen[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append(p)
    expected = defaultdict(int)
    for (i, _), found in ids_of.items():
        expected[i] += sum(map(len, found))
    assert seen == expected
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at & (at - 1) == 0 and at <= 2048 and {p["tier"] for p in pieces} == {at}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=80))
def test_tiers_hold_every_id_once(lengths):
    pieces = [packing.Piece(k, np.arange(n), 0, n) for k, n in enumerate(lengths)]
    windows, over = packing.pack_tiers(pieces)
    assert sum(p.length for p in over) < 2048
    windows += packing.deal_rest(over)
    spans = sorted((p.doc_id, p.start, p.length) for w in windows for p in w)
    at = {k: 0 for k in range(len(lengths))}
    for doc, start, length in spans:
        assert start == at[doc] and length > 0
        at[doc] += length
    assert list(at.values()) == lengths
    assert all((n := sum(p.length for p in w)) & (n - 1) == 0 and n <= 2048 for w in windows)


def test_step_groups_are_even():
    lengths = [2048] * 100 + [1024] * 50 + [256] * 30
    groups = packing.step_groups(lengths, 16_384)
    sums = np.bincount(groups, weights=lengths)
    assert sums.max() - sums.min() <= 2048


@pytest.mark.parametrize("ahead", [1, 7])
def test_shards(spark, ahead, monkeypatch):
    import hashlib

    monkeypatch.setattr(sharding, "AHEAD", ahead)
    monkeypatch.setattr(sharding, "AHEAD_LATER", ahead)
    rng = random.Random(4)
    rows = [(k, "x" * rng.randrange(60), "s") for k in range(400)] + [(500, None, "s"), (501, "é" * 200, "s"), (None, "abc", "s"), (7, "y" * 10, "s")]
    found = sharding.assign_shards(table(spark, rows), limit_bytes=300).collect()
    assert sorted((str(r.doc_id), r.bytes) for r in found) == sorted((str(i), len((t or "").encode())) for i, t, _ in rows)
    bits = lambda i: bin(int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    size = defaultdict(int)
    for r in found:
        assert bits(r.doc_id).startswith(r.shard_id) and r.depth == len(r.shard_id)
        size[r.shard_id] += r.bytes
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for r in found:
        assert r.shard_bytes == size[r.shard_id]
        assert size[r.shard_id] <= 300 or {x.doc_id for x in found if x.shard_id == r.shard_id} == {501}
        if r.depth:  # no bucket was split without need
            assert len({i for i, _, _ in rows if bits(i).startswith(r.shard_id[:-1])}) > 1
            assert sum(len((t or "").encode()) for i, t, _ in rows if bits(i).startswith(r.shard_id[:-1])) > 300


def test_shards_are_written_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randrange(60), "s") for k in range(400)] + [(500, None, "s"), (501, "é" * 200, None), (None, "abc", "s"), (7, "y" * 10, "s"), (7, "y" * 10, "s")]
    docs, path = table(spark, rows), str(tmp_path / "shards")
    sharding.write_shards(docs, path, limit_bytes=300)
    back = sharding.read_shards(spark, path)
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, docs.collect()))
    sized = back.select("row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)), "shard_id", F.length("shard_id"))
    assigned = sharding.assign_shards(docs, limit_bytes=300).drop("shard_bytes")
    assert sorted(map(str, map(tuple, sized.collect()))) == sorted(map(str, map(tuple, assigned.collect())))
    folders = [f for f in (tmp_path / "shards").iterdir() if f.is_dir()]
    assert len(folders) == assigned.select("shard_id").distinct().count() > 10
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folders)


def test_few_rows_are_sharded(spark, tmp_path):
    sharding.write_shards(table(spark, [(1, "a", "s")]), str(tmp_path / "one"))
    assert [(r.row.doc_id, r.shard_id) for r in sharding.read_shards(spark, str(tmp_path / "one")).collect()] == [(1, "")]
    sharding.write_shards(spark.createDataFrame([], DOCS), str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_one_huge_document_among_small_ones(spark):
    """No bit pattern without rows is listed, and the huge one is settled where it stands alone."""
    found = sharding.assign_shards(table(spark, [(1, "x" * 3_000_000, "s"), (2, "a", "s"), (3, "b", "s")]), limit_bytes=10).collect()
    assert len(found) == 3 and max(r.depth for r in found) < 20
    assert {r.doc_id for r in found if r.shard_bytes > 10} == {1}


def test_packed_ids_are_the_texts(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["alpha", "beta.", "Gamma"]) for _ in range(rng.randrange(3000))), "s") for k in range(20)] + [(100 + k, t, None) for k, t in enumerate(TEXTS)]
    packed = packing.pack(table(spark, rows)).cache()
    pieces = packed.collect()
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    of_doc = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        of_doc[p.doc_id] += p.ids
    assert dict(of_doc) == {i: [*tokenizer.model.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t, _ in rows}
    found = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in found.values():
        assert r.ids == [x for p in sorted((p for p in pieces if p.sequence_id == r.sequence_id), key=lambda p: p.offset) for x in p.ids]
        assert len(r.ids) == r.tier
    assert len(found) == len({p.sequence_id for p in pieces})
    bare = packing.pack(table(spark, rows), with_ids=False).collect()
    assert sorted(map(str, bare)) == sorted(str(r) for r in packed.drop("ids").collect())

from __future__ import annotations

import random
from itertools import islice

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import quality_classifier as qc
from plumbline.llm import quality_rules as qr
from plumbline.llm import simhash
from plumbline.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string"
EXTRA = DOCS + ", fp long, _m string, score double, row string, copies int"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def brute_fingerprint(text):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs):
    """Smallest id reachable, from ``(id, fingerprint)``."""
    lowest = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for i, a in pairs:
            for j, b in pairs:
                if bin(a ^ b).count("1") <= 4 and lowest[j] < lowest[i]:
                    lowest[i], changed = lowest[j], True
    return lowest


def test_fingerprint_matches_brute_force(monkeypatch):
    texts = [None, "", " \n\t", "one", "A b\x0bC d", "É b c d e É", words(1, 500), "x" * 100, words(2, 3)]
    expected = [brute_fingerprint(t) for t in texts]
    found = lambda: [simhash.fingerprint(None if t is None else t.encode()) for t in texts]
    assert found() == expected
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)  # long texts are hashed in pieces
    assert found() == expected


@pytest.mark.parametrize(
    "text",
    ["a " + "x" * 100 + " b", "a\n" + "x" * 100, " " + "x" * 49 + " " + "y" * 50, "a b c " + "x" * 130 + "\tb c d e " + "z" * 70, " " * 120 + "x" * 51 + " " * 60],
)
def test_pieces_of_long_words_end(text, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    pieces = list(islice(simhash._pieces(text.encode()), 1000))  # bounded: a loop that doesn't end must fail here
    assert b"".join(pieces) == text.encode() and all(pieces)
    assert [w for p in pieces for w in p.split()] == text.encode().split()
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_jvm_and_python_hash_agree(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c d", 42)).astype(np.int64)


@pytest.fixture(scope="module")
def dedup_rows():
    base = words(7, 60)
    rows = [(k, words(k, 50), "en", "s") for k in range(40)]
    near = base.split()
    for k in range(25):  # one word differs
        near[k] = f"new{k}"
        rows.append((100 + k, " ".join(near), "en", "s"))
        near[k] = base.split()[k]
    rows += [(200, base, "en", "s"), (201, base, "en", "s"), (201, base, "en", "s"), (202, None, None, None), (203, "", "en", "s"), (None, base, "en", "s")]
    return rows


def test_near_duplicates(spark, dedup_rows, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "m", 0.1, "r", 2) for r in dedup_rows], EXTRA)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(dedup_rows)
    expected = brute_components([(r[0], brute_fingerprint(r[1])) for r in dedup_rows if r[0] is not None])
    for row in found:
        assert row.component_id == (expected[200] if row.doc_id is None else expected[row.doc_id])
    assert {r.fingerprint for r in found if r.doc_id in (202, 203)} == {"0" * 16}
    assert len({r.component_id for r in found if r.doc_id in (202, 203)}) == 1


def test_rows_without_ids_link_but_name_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "s"), (None, "A b c", "en", "s"), (4, "x y z q", "en", "s")], DOCS)
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()) == [("4", 4), ("None", None), ("None", None)]


def test_one_of_each_keeps_a_row_of_every_component(spark, dedup_rows):
    """By row, not by id: equal rows leave one, and rows that share an id with a copy stay."""
    unique = words(31, 60)
    rows = [*dedup_rows, (1, words(0, 50), "de", "s"), (1, unique, "en", "s"), (None, words(32, 60), "en", "s"), (None, words(32, 60), "en", "s"), (300, words(33, 60), "en", "s"), (300, words(33, 60), "en", "s")]
    docs = spark.createDataFrame([(*r, 1, "m", 0.1, "r", 2) for r in rows], EXTRA)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text, r.lang) for r in kept.collect()]
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = brute_components(list(enumerate(fps)))
    assert len(kept) == len(set(group.values()))
    lowest = {}
    for n, r in enumerate(rows):
        lowest.setdefault(group[n], []).append((r[0] is None, r[0] or 0))
    for doc_id, text, lang in kept:
        n = next(n for n, r in enumerate(rows) if r[:3] == (doc_id, text, lang))
        assert (doc_id is None, doc_id or 0) == min(lowest.pop(group[n]))
    assert not lowest and any(t == unique for _, t, _ in kept)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("resplits", [0, 1, 2])
def test_full_nodes_are_dealt_again_and_by_salts(spark, dedup_rows, resplits, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 3)
    monkeypatch.setattr(simhash, "RESPLITS", resplits)
    docs = spark.createDataFrame(dedup_rows, DOCS)
    expected = brute_components([(r[0], brute_fingerprint(r[1])) for r in dedup_rows if r[0] is not None])
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert found == expected


@pytest.mark.parametrize("flips", [2, 5])
def test_tree_walk_finds_every_link(flips):
    rng = np.random.default_rng(flips)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (flips, 300), dtype=np.uint64), axis=0) for c in centre]))
    gray = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    fps = fps[np.argsort(gray)]
    parent = np.arange(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    simhash._union(parent, a, b)
    assert (simhash.spanning_links(fps, np.zeros(len(fps), np.int64)) == parent).all()


@pytest.mark.parametrize("count", [1, 10**6, 10**9, 10**12])
def test_masks_cover_every_difference(count):
    chosen = [m & (1 << 64) - 1 for m in simhash.masks(count)]
    rng = random.Random(3)
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not difference & m for m in chosen)


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (50, 50)]
    found = connected_components(spark.createDataFrame(chain, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(1, 31)} | {(101, 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert simhash.near_duplicates(none).count() == 0
    assert qr.quality_report(none).count() == 0 and qr.quality_filter(none).count() == 0
    assert qc.quality_scores(none, labels).count() == 0


def brute_repeats(text):
    parts = (text or "").encode().split()
    grams = [tuple(parts[i : i + 8]) for i in range(len(parts) - 7)]
    return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)})


def test_quality_counts(spark):
    loop = "a b c d e f g h i "
    texts = [None, "", "one", loop * 2, loop + "x " + loop, words(5, 300), "l1\nl2\nl1\n \n\nl1", "é#ñ *| $", words(9, 20) + " " + words(9, 20), "same " * 50]
    docs = spark.createDataFrame([(k, t, None, None, 1, "m", 0.1, "r", 2) for k, t in enumerate(texts)] + [(None, "x", "en", "s", 1, "m", 0.1, "r", 2)], EXTRA)
    found = {r.doc_id: r for r in qr.quality_report(docs).collect()}
    for k, t in enumerate(texts):
        parts = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.split()]
        r = found[k]
        assert r.n_words == len(parts), k
        assert r.word_chars == sum(len(p.decode()) for p in parts)
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(t), k
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert None in found


def test_divergent_documents_go(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to"] + ["house", "river", "table", "garden", "window", "yellow"]) for _ in range(n)) + "."
    rows = [(k, prose(200), "en", "s") for k in range(40)]
    rows += [(100, prose(200).upper(), "en", "s"), (101, prose(200).replace(" ", "$$$ "), "en", "s"), (102, " | ".join(words(k, 1) for k in range(200)), "en", "s"), (103, prose(19).upper(), "en", "s")]
    docs = spark.createDataFrame([(*r, 1, "m", 0.1, "r", 2) for r in rows], EXTRA)
    kept = {r.doc_id for r in qr.quality_filter(docs).collect()}
    assert kept == set(range(40))
    assert qr.quality_filter(docs).columns == docs.columns
    report = {r.doc_id: r.kept for r in qr.quality_report(docs).collect()}
    assert {k for k, v in report.items() if v} == kept


@pytest.mark.parametrize("broadcast", [1000, 1])
def test_each_language_has_its_own_reference(spark, broadcast, monkeypatch):
    monkeypatch.setattr(qr, "BROADCAST_LANGS", broadcast)
    rng = random.Random(6)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(k, prose("абвгдежзик", 150), "ru", "s") for k in range(60)]
    rows += [(100 + k, prose("的一是不了人我在有他", 150), "zh", "s") for k in range(30)]
    rows += [(200 + k, prose("ABCDEFGHIK", 150), None if k else " ", "s") for k in range(4)]  # unknown
    rows += [(300, prose("abcdefghik", 150).upper(), "en-US", "s"), (301, "short", None, "s")]  # too small a reference
    rows += [(400, prose("абвгдежзик", 150).upper(), "ru", "s"), (401, "1 2 3 4 5 " * 60, "zh", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in qr.quality_filter(docs).collect()}
    assert kept == {*range(60), *range(100, 130), *range(200, 204), 300}
    assert {r.doc_id for r in qr.quality_report(docs).where("kept").collect()} == kept


@pytest.mark.parametrize("literal", [50_000, 3])
def test_common_words_come_from_the_table(spark, literal, monkeypatch):
    """Counts, shares and distances against plain Python, with words as constants of the plan and joined."""
    import math
    from collections import Counter

    monkeypatch.setattr(qr, "LITERAL_WORDS", literal)
    rng = random.Random(12)
    rows = []
    for lang, often in (("xx", ["ka", "lo", "mi"]), ("yy", ["te", "ka", "su", "vo"])):
        for k in range(30):
            text = " ".join(rng.choice(often * 3 + [f"{lang}{rng.randrange(5000)}"]) for _ in range(250))
            rows.append((len(rows), text.replace("ka ", "Ka, "), lang, "s"))
    rows.append((900, " ".join(["te"] * 140 + [f"q{k}" for k in range(20)]), "xx", "s"))
    rows.append((901, " ".join(f"q{k}" for k in range(400)), "xx", "s"))
    docs = spark.createDataFrame(rows, DOCS)
    bare = lambda t: [w.lower().rstrip(".,;:!?") for w in t.split()]
    shares = {}
    for lang in ("xx", "yy"):
        c = Counter(w for _, t, x, _ in rows if x == lang for w in bare(t))
        total = sum(c.values())
        shares[lang] = {w: n / total for w, n in c.items() if n * qr.COMMON_PART >= total}
    assert {(r.lang, r.w): r.share for r in qr.common_words(docs).collect()} == {(x, w): q for x in shares for w, q in shares[x].items()}
    for r in qr.quality_report(docs).collect():
        _, text, lang, _ = next(x for x in rows if x[0] == r.doc_id)
        words_, ref = bare(text), shares[lang]
        c = Counter(w for w in words_ if w in ref)
        p = [c[w] / len(words_) for w in ref] + [1 - sum(c.values()) / len(words_)]
        q = [*ref.values(), 1 - sum(ref.values())]
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        assert abs(r.common_distance - math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))) < 1e-9


def test_very_long_texts_are_measured_whole(spark):
    texts = ["x" * 3_000_000, "a b c d e f g h " * 40_000, "\n".join(["line of words"] * 30_000)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r for r in qr.quality_report(docs).collect()}
    assert [(found[k].n_words, found[k].word_chars) for k in range(3)] == [(1, 3_000_000), (320_000, 320_000), (90_000, 30_000 * 11)]
    assert found[1].n_repeat_words == 320_000 and found[2].n_dup_lines == 29_999
    scores = qc.quality_scores(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")).collect()
    assert len(scores) == 3 and all(0 <= r.score <= 1 for r in scores)


def labelled(spark, n=200):
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        rows.append((k, (words(k, 60).upper() + "!! ###") if bad else words(k, 60), "en", "s", 1, "m", 0.1, "r", 2))
        labels.append((k, 0 if bad else 1))
    rows += [(n, None, None, None, None, None, None, None, None), (n + 1, "", "en", "s", 1, "m", 0.1, "r", 2), (None, "x y", "en", "s", 1, "m", 0.1, "r", 2), (3, words(3, 60), "en", "s", 1, "m", 0.1, "r", 2)]
    labels += [(None, 1), (5, 1), (7, None), (9, 7)]
    return spark.createDataFrame(rows, EXTRA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifier(spark):
    import zlib

    docs, labels = labelled(spark)
    found = qc.quality_scores(docs, labels).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 200:
            assert r.predicted == int(r.doc_id % 5 != 0)
    again = {(r.doc_id, r.score) for r in qc.quality_scores(docs, labels).collect()}
    assert again == {(r.doc_id, r.score) for r in found}
    kept = qc.quality_accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 200} == {k for k in range(200) if k % 5}


def test_fit_equals_a_plain_solver():
    """Plain gradient descent on the same pairs, written out anew, ends at the same weights."""
    rng = np.random.default_rng(4)
    n, width = 300, len(qc.FEATURES)
    x = rng.normal(size=(n, width)) * rng.uniform(0.5, 3, width)
    label = (x @ rng.normal(size=width) + rng.normal(size=n) * 3 > 0).astype(int)
    model = qc.fit(x, label)
    pairs, scale = qc.preference_pairs(x, label)
    w = np.zeros(width)
    for _ in range(4000):
        gain = 1 / (1 + np.exp(pairs @ w))
        w += 0.2 * ((pairs * gain[:, None]).mean(axis=0) - qc.RIDGE * w)
    assert np.abs(np.array(model.weights) * scale - w).max() < 1e-3
    # the cut is the best of all
    strength = x @ np.array(model.weights)
    told = lambda cut: (strength[label == 1] >= cut).mean() + (strength[label == 0] < cut).mean()
    assert abs(told(model.cut) - max(told(c) for c in [*strength, np.inf])) < 1e-12


def test_scores_equal_those_of_plain_python(spark):
    docs, labels = labelled(spark)
    model = qc.train(docs, labels)
    by_text = {r.text: r.doc_id for r in docs.collect()}
    texts = list(by_text)
    common = {}
    for r in docs.join(labels.where("quality in (0, 1)").select("doc_id", "quality").distinct(), "doc_id").collect():
        if r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in {qc._bare(x) for x in (r.text or "").encode().split()}:
                common.setdefault(w, []).append(r.doc_id)
    most = sorted(common, key=lambda w: (-len(common[w]), w))[: qc.COMMON_WORDS]
    assert model.common == frozenset(most)
    z = np.array([qc.features(None if t is None else t.encode(), model.common) for t in texts]) @ np.array(model.weights) - model.cut
    expected = dict(zip(texts, 1 / (1 + np.exp(-z - np.log(7 / 3))), strict=True))
    for r in qc.quality_scores(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert abs(r.score - expected[r.text]) < 1e-9 or r.predicted == int(expected[r.text] >= 0.7)


def test_sample_is_a_parameter(spark):
    docs, labels = labelled(spark)
    assert qc.train(docs, labels, sample_rows=20) != qc.train(docs, labels)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("quality", F.when(qc.remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert qc.train(docs, labels) == qc.train(docs, turned)


def test_without_both_labels_nothing_is_rejected(spark):
    docs, labels = labelled(spark)
    found = qc.quality_scores(docs, labels.where("quality = 1")).collect()
    assert {(r.score, r.predicted) for r in found} == {(0.7, 1)}

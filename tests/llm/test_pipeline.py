"""Every stage of the pipeline, and the whole, against plain Python."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumbline.llm import packing
from plumbline.llm import quality_classifier as qc
from plumbline.llm import quality_rules as qr

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def rows(spark):
    """The documents, with what a table may hold besides, and columns with the operators' own names."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select(COLUMNS).collect()]
    clean = [r for r in docs if r[1] and len(r[1].split()) > 200][:6]
    odd = [
        clean[0],  # equal in every column
        (clean[1][0], clean[2][1] + " and more of it", *clean[1][2:]),  # shares an id with another text
        (None, *clean[3][1:]),  # a copy without an id
        (None, clean[4][1] + " once more", None, None, None),
        (None, clean[4][1] + " once more", None, None, None),
        (10**9, None, "en", "src0", 0),
        (10**9 + 1, "", "en", None, 0),
        (10**9 + 2, clean[5][1] + " " + "x" * 200_000, "en", "src1", 1),
    ]
    return [(*r, 1.5, "m", 2) for r in docs + odd]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, copies int")


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, rows):
    """What each stage makes of the rows that the one before kept."""
    found, docs = [Counter(rows)], table(spark, rows)
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns
        found.append(as_rows(after))
        docs = table(spark, list(found[-1].elements()))
    return [*found, [r.asDict() for r in cp.STAGES[-1][1](spark, docs, DATA).collect()]]


def test_classifier_stage(spark, rows, stages):
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/labels.parquet").collect():
        if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            labels[r.doc_id].append(r.quality)
    learnt = [(r[0], r[1]) for r in rows if r[0] in labels]
    held = Counter(w for _, t in learnt for w in {qc._bare(x) for x in (t or "").encode().split()})
    common = frozenset(sorted(held, key=lambda w: (-held[w], w))[: qc.COMMON_WORDS])
    features = lambda t: qc.features(None if t is None else t.encode(), common)
    by_id = defaultdict(list)
    for i, t in learnt:
        by_id[i].append(features(t))
    ids = sorted(by_id)
    model = qc.fit(np.array([np.mean(by_id[i], axis=0) for i in ids]), np.array([min(labels[i]) for i in ids]), common)
    assert stages[1] == Counter(r for r in rows if model.scores(np.array([features(r[1])]))[0] >= qc.ACCEPT)
    assert 0.5 * len(rows) < sum(stages[1].values()) < len(rows)


def kinds_of(text):
    """Counts of the character classes, in the rules' order, with all others last."""
    def kind(c):
        cat = unicodedata.category(c)
        if c in " \t\n\x0b\x0c\r":
            return 1
        if cat in ("Ll", "Lu"):
            return 0 if cat == "Ll" else 2
        return 3 if c in "#*$%&|<>" else 4 if cat[0] == "P" else 5 if cat[0] == "N" else 6

    return [sum(kind(c) == k for c in text) for k in range(7)]


def distance(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def test_rules_stage(stages):
    rows = list(stages[1].elements())
    words = lambda t: [w for w in re.split("[ \\t-\\r]+", t or "") if w]
    bare = lambda t: [w.lower().rstrip(".,;:!?") for w in words(t)]
    counts, classes = defaultdict(Counter), defaultdict(lambda: np.zeros(7))
    for _, t, lang, *_ in rows:
        counts[lang].update(bare(t))
        classes[lang] += kinds_of(t or "")
    kept = []
    for r in rows:
        own, lang = words(r[1]), r[2]
        windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        repeated = len({i + j for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for j in range(8)})
        good = len(own) >= 20 and 100 * repeated <= 30 * len(own)
        if lang is not None and classes[lang].sum() >= qr.MIN_REFERENCE_CHARS:
            mine, total = kinds_of(r[1] or ""), sum(counts[lang].values())
            if sum(mine) >= qr.MIN_CHARS:
                good &= distance([x / sum(mine) for x in mine], list(classes[lang] / classes[lang].sum())) <= qr.MAX_CLASS_DISTANCE
            if len(own) >= qr.MIN_JUDGED_WORDS and total >= qr.MIN_REFERENCE_WORDS:
                ref = {w: c / total for w, c in counts[lang].items() if c * qr.COMMON_PART >= total}
                seen = Counter(w for w in bare(r[1]) if w in ref)
                p = [seen[w] / len(own) for w in ref] + [1 - sum(seen.values()) / len(own)]
                good &= distance(p, [*ref.values(), 1 - sum(ref.values())]) <= qr.MAX_COMMON_DISTANCE + qr.COMMON_SLACK / math.sqrt(len(own))
        if good:
            kept.append(r)
    assert stages[2] == Counter(kept)
    assert 0.5 * len(rows) < len(kept) < len(rows)


def fingerprint(text):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_copies_stage(stages):
    rows = list(stages[2].elements())
    fps = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    members = defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        members[g].append(r)
    place = lambda r: (r[0] is None, r[0] or 0)
    kept = list(stages[3].elements())
    assert len(kept) == len(members) < len(rows)
    for held in members.values():
        mine = [r for r in kept if r in held]
        assert len(mine) == 1 and place(mine[0]) == min(map(place, held))


def test_mixing_stage(stages):
    size = lambda r: len((r[1] or "").encode().split())
    by_source = defaultdict(list)
    for r, n in stages[3].items():
        assert n == 1
        by_source[r[3]].append(r)
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(map(size, by_source[s])) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        share = (sum(total.values()) - sum(3 * total[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * share > 3 * total[s]}
        if not over:
            break
        capped |= over
    assert set(stages[4]) <= set(stages[3]) and max(stages[4].values()) <= 3
    for s in names:
        target = 3 * total[s] if s in capped else weight[s] * share
        taken = sum(size(r) * stages[4][r] for r in by_source[s])
        smallest = sorted(map(size, by_source[s]))[len(by_source[s]) // 2]
        assert abs(taken - target) <= max(smallest, 0.01 * target), s


def test_packing_stage(stages):
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    expected = Counter()
    for r, n in stages[4].items():
        expected[r[0], (*tokenizer.model.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID)] += n
    # copies of a document are told apart by the pieces that follow one another
    starts, ends, windows = Counter(), Counter(), defaultdict(list)
    for p in stages[5]:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        starts[p["doc_id"], p["doc_tokens"], p["start"]] += 1
        ends[p["doc_id"], p["doc_tokens"], p["start"] + p["length"]] += 1
        windows[p["sequence_id"]].append(p)
        assert any(i == p["doc_id"] and list(ids[p["start"] : p["start"] + p["length"]]) == p["ids"] for i, ids in expected)
    docs = Counter()
    for (i, ids), n in expected.items():
        docs[i, len(ids)] += n
    for (i, tokens), n in docs.items():
        assert starts[i, tokens, 0] == n == ends[i, tokens, tokens]
    assert sum(p["length"] for p in stages[5]) == sum(len(ids) * n for (_, ids), n in expected.items())
    assert all(k[2] == 0 or starts[k] == ends[k] for k in starts)
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at & (at - 1) == 0 and at <= 2048


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(COLUMNS)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    kept = Counter(r.doc_id for r in docs.select("doc_id").collect())
    found = cp.run(spark, DATA)
    assert Counter(r.doc_id for r in found.where("start = 0").select("doc_id").collect()) == kept


def test_empty_tables(spark, rows):
    for _, stage in cp.STAGES:
        assert stage(spark, table(spark, rows).where(F.lit(False)), DATA).count() == 0

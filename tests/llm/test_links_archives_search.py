from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import arc_convert as arc
from plumbline.llm import inner_topk, license_scan, quote_threads


def test_quotes(spark):
    mails = [
        ("c", 0, "Shall we meet?\nAt noon?"),
        ("c", 1, "Yes.\n\nOn Monday Ann wrote:\n> Shall we meet?\n> At noon?"),
        ("c", 2, "> Yes.\n>> Shall we meet?\n>> At  NOON?\n\nGood"),
        ("c", 3, "Only a part\n> At noon?"),
        ("c", 4, "No idea\n> never written"),
        ("c", 5, None),
        ("c", 6, ""),
        ("d", 0, "Yes."),
        ("d", 1, "me too\n> Yes."),
        (None, 0, "x y"),
        (None, 1, "z\n> x y"),
        ("c", 1, "A"),
        ("c", None, "no place"),
        ("e", 0, "same"),
        ("e", 1, "same\n> same"),
        ("e", 2, "same\n> same\n>> same"),
    ]
    table = spark.createDataFrame([(*m, "x", 1) for m in mails], "conv_id string, turn int, text string, msg string, scope int")
    found = {(r.scope, r.msg): r for r in quote_threads.link_quotations(table).collect()}
    assert len(found) == 14
    link = {k: (r.parent, r.root, r.depth) for k, r in found.items()}
    assert link["c", 0] == (None, 0, 0) and link["c", 1] == (0, 0, 1) and link["c", 2] == (1, 0, 2)
    assert link["c", 4] == (None, 4, 0) and link["c", 5] == (None, 5, 0) and link["c", 6] == (None, 6, 0)
    assert link["d", 1] == (0, 0, 1) and link[None, 1] == (0, 0, 1)
    assert link["e", 1] == (0, 0, 1) and link["e", 2] == (1, 0, 2)
    assert found["c", 2].own_text == "\nGood" and found["c", 1].own_text == "Yes."
    empty = quote_threads.link_quotations(table.limit(0))
    assert empty.count() == 0


def test_long_thread(spark):
    turns = [(1, k, f"turn number {k}") for k in range(70)] + [(2, 0, "alone")]
    mails = quote_threads.as_mails(spark.createDataFrame(turns, "conv_id int, turn int, text string"))
    found = {(r.scope, r.msg): (r.parent, r.root, r.depth) for r in quote_threads.link_quotations(mails).collect()}
    assert found == {(1, k): (k - 1 if k else None, 0, k) for k in range(70)} | {(2, 0): (None, 0, 0)}


def test_passages_of_interleaved_replies(spark):
    mails = [(1, 0, "first point"), (1, 1, "second point"), (1, 2, "> first point\nno\n> second point\nyes")]
    found = quote_threads.link_quotations(spark.createDataFrame(mails, "conv_id int, turn int, text string"))
    assert {r.msg: r.parent for r in found.collect()}[2] == 1


def test_trimmed_quotes_and_missing_parents(spark):
    mails = [
        ("c", 0, "Shall we meet?\nAt noon?"),
        ("c", 3, "Only a part\n> At noon?"),
        ("p", 0, "Hello\n\nFirst idea\ngoes on.\n\nSecond idea."),
        ("p", 1, "Other\n\nThird idea."),
        ("p", 2, "> First idea\n> goes on.\nno"),  # a paragraph
        ("p", 3, "> Hello\n>\n> Second idea.\nyes"),  # paragraphs with the text between them trimmed
        ("p", 4, "> goes on.\n> never written\nhm"),  # one line of the quotation
        ("p", 5, "> ***\nstars"),
        ("m", 0, "Shall we meet?\nAt noon?"),
        ("m", 2, "> Lost mail.\n>> Shall we meet?\n>> At  NOON?\n\nGood"),  # message 1 is missing
        ("m", 3, "> Gone.\n>> Lost.\n>>> At noon?\nFine"),
        ("m", 4, "> Good\n>> Shall we meet?\n>> At noon?\nNear before deep"),
        ("w", 0, "Yes.\nLong"),
        ("w", 1, "Yes."),
        ("w", 2, "> Yes.\nwhole messages come first"),
    ]
    table = spark.createDataFrame(mails, "conv_id string, turn int, text string")
    parent = {(r.scope, r.msg): r.parent for r in quote_threads.link_quotations(table).collect()}
    assert parent == {
        ("c", 0): None, ("c", 3): 0,
        ("p", 0): None, ("p", 1): None, ("p", 2): 0, ("p", 3): 0, ("p", 4): 0, ("p", 5): None,
        ("m", 0): None, ("m", 2): 0, ("m", 3): 0, ("m", 4): 2,
        ("w", 0): None, ("w", 1): None, ("w", 2): 1,
    }


def test_equal_turns_gaps_and_marks_follow_the_turn_before(spark):
    """Rendered as mails and linked again, every turn answers the one before it, as the SQL has it."""
    odd = ["> quoted by hand\nreal", "On Monday Ann wrote:\nhello", " > stuffed\n  >> twice", "a\r\nb ", "> ", "plain"]
    turns = [(1, k, "same text") for k in range(6)] + [(2, k, f"t{k}") for k in (0, 2, 3, 9)] + [(None, k, "same text") for k in range(3)]
    turns += [(3, k, t) for k, t in enumerate(odd)] + [(4, 0, "dup"), (4, 0, "dup"), (4, 1, "dup"), (5, None, "lost")]
    table = spark.createDataFrame(turns, "conv_id int, turn int, text string")
    found = {(r.scope, r.msg): r for r in quote_threads.link_quotations(quote_threads.as_mails(table)).collect()}
    expected = {}
    for scope in {t[0] for t in turns} - {5}:
        numbers = sorted({t[1] for t in turns if t[0] == scope})
        for n, k in enumerate(numbers):
            expected[scope, k] = (numbers[n - 1] if n else None, numbers[0], n, n)
    assert {k: (r.parent, r.root, r.depth, r.ordinal) for k, r in found.items()} == expected
    for scope, k, text in turns:
        if scope != 5:
            assert found[scope, k].own_text == text.rstrip(" \t\n")


def test_very_long_lines_and_texts(spark):
    rows = [(1, 0, "> " * 100_000 + "x"), (1, 1, ">" * 100_000), (1, 2, "y" * 3_000_000), (1, 3, "> " + "y" * 3_000_000 + "\nz"), (1, 4, " >" * 50_000)]
    found = {r.msg: r for r in quote_threads.link_quotations(spark.createDataFrame(rows, "conv_id int, turn int, text string")).collect()}
    assert found[0].own_text == "" and found[3].parent == 2 and found[3].own_text.strip() == "z"
    assert quote_threads.as_mails(spark.createDataFrame(rows, "conv_id int, turn int, text string")).count() == 5


def test_reply_order_within_a_thread(spark, monkeypatch):
    monkeypatch.setattr(quote_threads, "STRETCH", 4)
    mails = [(1, 0, "root")] + [(1, k, f"> root\nanswer {k}") for k in range(1, 20)] + [(1, 30, "other"), (1, 31, "> answer 7\nx"), (1, 32, "> other\ny")]
    found = {r.msg: (r.root, r.depth, r.ordinal) for r in quote_threads.link_quotations(spark.createDataFrame(mails, "conv_id int, turn int, text string")).collect()}
    assert found == {0: (0, 0, 0)} | {k: (0, 1, k) for k in range(1, 20)} | {30: (30, 0, 0), 31: (0, 2, 20), 32: (30, 1, 1)}


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def brute_scan(docs, templates):
    def grams(text):
        parts = (text or "").encode().lower().translate(license_scan._BLANKED).split()
        return [b" ".join(parts[i : i + 5]) for i in range(len(parts) - 4)]

    out = set()
    for doc, text in docs:
        have = set(grams(text))
        for name, t in templates:
            wanted = set(grams(t))
            if wanted and len(wanted & have) >= 0.8 * len(wanted):
                out.add((doc, name))
    return out


def test_templates(spark, monkeypatch):
    templates = [(f"t{n}-{k}", " ".join(words(1000 * n + k, n))) for n in (5, 6, 7, 9, 12, 17, 33, 60, 64, 65, 130, 400) for k in range(2)]
    templates += [("short", "too few words"), ("null", None), ("copy", templates[0][1]), (None, "x")]
    docs, rng = [], random.Random(5)
    for k, (name, t) in enumerate(templates[:24]):
        body = words(10_000 + k, rng.randrange(400))
        parts = t.split()
        if len(parts) > 60:  # a near copy: one word in sixty differs
            parts[30] = "changed"
        at = rng.randrange(len(body) + 1)
        docs.append((k, " ".join(body[:at] + parts + body[at:])))
    docs += [(100 + k, " ".join(words(50_000 + k, 300))) for k in range(20)]
    docs += [(200, None), (201, ""), (202, "Foo. released under the MIT license. bar"), (None, templates[5][1]), (203, templates[7][1] + ". " + templates[7][1]), (203, templates[7][1])]
    table = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, template string, containment double")
    known = spark.createDataFrame(templates, "template string, text string").unionByName(license_scan.license_templates(spark))
    known_licenses = [tuple(r) for r in license_scan.license_templates(spark).collect()]
    expected = brute_scan(docs, [t for t in templates if t[0]] + known_licenses)
    found = license_scan.scan_templates(table, known).collect()
    assert {(r.doc_id, r.template) for r in found} == expected
    assert len(found) == len(expected) + 1 and all(r.containment >= 0.8 for r in found)
    monkeypatch.setattr(license_scan, "ROUND_WORDS", 900)
    monkeypatch.setattr(license_scan, "STRETCH", 64)
    again = license_scan.scan_templates(table, known).collect()
    assert {(r.doc_id, r.template) for r in again} == expected
    assert license_scan.scan_templates(table.limit(0), known).count() == 0
    assert license_scan.scan_templates(table, known.limit(0)).count() == 0


def test_licence_texts_and_long_documents(spark):
    from plumbline.llm.licenses import TEXTS

    long = " ".join(words(77, 120_000))
    rows = [(k, f"Copyright (c) 2020 Someone {k}\n" + re.sub(r"\s+", "\n * ", t)) for k, t in enumerate(TEXTS.values())]
    rows += [(100, long + TEXTS["isc"] + long), (101, TEXTS["mit"][: len(TEXTS["mit"]) // 2]), (102, TEXTS["zlib"].replace("software", "code", 2))]
    found = license_scan.scan_templates(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.license_templates(spark)).collect()
    expected = brute_scan(rows, [tuple(r) for r in license_scan.license_templates(spark).collect()])
    assert {(r.doc_id, r.template) for r in found} == expected
    assert {(k, f"license-text:{name}") for k, name in enumerate(TEXTS)} | {(100, "license-text:isc")} <= expected
    assert next(r.first_word for r in found if (r.doc_id, r.template) == (100, "license-text:isc")) == 120_000


ARC_1 = (
    b"filedesc://a.arc 0.0.0.0 20010101000000 text/plain 77\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n".replace(b"77", b"%d" % len(b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"))
    + b"\nhttp://a.example/ 1.2.3.4 20010203040506 text/html 27\nHTTP/1.0 200 OK\r\n\r\nbody\nhi\n\n"
    + b"dns:a.example 1.2.3.4 20010203 text/dns 4\nabcd\n"
)


def test_arc_by_hand():
    records = list(arc.parse_arc(ARC_1))
    assert [(r.version, r.fields["URL"], r.payload) for r in records] == [(1, "http://a.example/", b"body\nhi\n"), (1, "dns:a.example", b"abcd")]
    (headers, block), = arc.parse_warc(arc.to_warc(records[0], "<urn:uuid:k>") + b"\r\n\r\n")
    assert headers["WARC-Date"] == "2001-02-03T04:05:06Z" and headers["WARC-Type"] == "response" and block == records[0].block
    (headers, _), = arc.parse_warc(arc.to_warc(records[1], "<urn:uuid:k2>") + b"\r\n\r\n")
    assert headers["WARC-Type"] == "resource" and headers["WARC-Date"] == "2001-02-03T00:00:00Z"
    assert arc.warc_date("2001") == "2001-01-01T00:00:00Z"
    for broken in (ARC_1[:-3], b"http://x 1 2 3 4\nabcd\n", ARC_1.replace(b" text/dns", b"")):
        with pytest.raises(ValueError):
            list(arc.parse_arc(broken))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    blocks = [b"", b"\n\n", b"HTTP/1.1 200 OK\r\n\r\nx\r\n\r\ny", bytes(range(256))]
    data = arc.build_arc(version, [(f"http://x/{k} é", "text/html", b) for k, b in enumerate(blocks)])
    found = list(arc.parse_arc(data))
    assert [r.block for r in found] == blocks and all(r.version == version for r in found)


def test_archive(spark):
    big, other = "<p>" + "é" * 600, "z" * 1000
    rows = [(1, "http://a/", big), (9, "http://b/ x", big), (5, None, big), (2, "u", other), (3, "u", "z" * 999), (4, "u", "z" * 999), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\nx\r\n\r\n\n"), (8, "u", "same id")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, refers_to string, record int")
    found = arc.archive_pages(pages).collect()
    assert len(found) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        r = next(r for r in found if r.page_id == i and r.payload_digest == hashlib.sha1(body).hexdigest())
        assert r.payload_bytes == len(body)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if html == big and i in (1, 5) else ("response", None))
    assert arc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [0, 1, -1, 2**62, 2**63 - 1, -(2**63), 12345678901234567])
def test_record_ids_spell_page_ids(page):
    assert arc.page_of(arc.record_id(page)) == page and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", arc.record_id(page))
    assert arc.page_of(arc.record_id(None)) is None is arc.page_of("<urn:uuid:f47ac10b-58cc-4372-a567-0e02b2c3d479>") is arc.page_of(None)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, "u", f"{k}" + "é" * 1_500_000) for k in range(8)], "page_id long, url string, html string").coalesce(1)
    # a worker has the module's own bounds: rows of 4 MB and a record, 8 rows a file
    monkeypatch.setattr(arc, "FILE_ROWS", 1)
    arc.write_warc(pages, str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) >= 3 and max(f.stat().st_size for f in files) < arc.ARCHIVE_BYTES + 3_100_000
    assert sorted(r.page_id for r in arc.read_warc(spark, str(tmp_path / "w")).collect()) == list(range(8))


def test_stored_archives_are_converted(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"long payload " * 100
    records = [("http://a/1", "text/html", body), ("http://a/2", "text/html", b"HTTP/1.1 200 OK\r\n\r\nshort"), ("dns:a", "text/dns", b"1.2.3.4")]
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "one.arc").write_bytes(arc.build_arc(1, records))
    (folder / "two.arc.gz").write_bytes(gzip.compress(arc.build_arc(2, [records[0], ("http://b/bytes", "image/png", bytes(range(256)))])))
    (folder / "notes.txt").write_text("no archive")
    arc.convert_archives(spark, str(folder), str(tmp_path / "warc"))
    found = arc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted((r.target_uri, r.warc_type) for r in found if r.target_uri != "http://a/1") == [
        ("dns:a", "resource"), ("http://a/2", "response"), ("http://b/bytes", "resource"),
    ]
    whole, again = sorted((r for r in found if r.target_uri == "http://a/1"), key=lambda r: r.warc_type)
    assert (whole.warc_type, again.warc_type) == ("response", "revisit") and again.refers_to == whole.record_id
    assert whole.payload_digest == again.payload_digest == hashlib.sha1(b"long payload " * 100).hexdigest()
    assert {r.payload_bytes for r in found if r.target_uri == "http://b/bytes"} == {256} and whole.page_id is None
    # the revisit names its original in full
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "warc").glob("part-*")))
    headers = next(h for h, _ in arc.parse_warc(raw) if h["WARC-Type"] == "revisit")
    assert headers["WARC-Refers-To-Target-URI"] == "http://a/1" and headers["WARC-Refers-To-Date"] == "2020-01-01T00:00:00Z"


def brute_top(rows, asked, k=5):
    """``rows`` are ``(id, vector)``; every row is a candidate of the others."""
    out = []
    for n, (q, mine) in enumerate(rows):
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=False)), i) for m, (i, v) in enumerate(rows) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", ["even", "skewed"])
def test_top_inner_products(spark, scale, monkeypatch):
    monkeypatch.setattr(inner_topk, "HEAD_ROWS", 40)
    monkeypatch.setattr(inner_topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(inner_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(inner_topk, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(inner_topk, "RUN_BLOCKS", 2)
    monkeypatch.setattr(inner_topk, "SLICE", 5)
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=12) * (1 if scale == "even" else 2.0 ** rng.integers(-4, 4))).astype(float).tolist()) for k in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [0.0] * 12), (250, rows[50][1][:7])]
    # rows that repeat an id are rows of their own
    rows += [(3, rows[3][1]), (7, rows[50][1]), (7, rows[51][1]), (50, rows[50][1]), (100, rows[9][1])]
    odd = [(300, None), (350, [float("nan")] * 12), (302, [None] * 12), (304, [float("inf")] + [0.0] * 11), (None, [1.0] * 12)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, rank int, score int")
    found = inner_topk.top_inner_products(table, F.col("vec_id") % 50 == 0).collect()
    scaled = [(i, np.floor(256 * np.array(v)).astype(int).tolist()) for i, v in rows]
    assert sorted(tuple(r) for r in found) == brute_top(scaled, lambda i: i % 50 == 0)


def test_repeated_candidates_all_count(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in inner_topk.top_inner_products(table, F.col("vec_id") == 0).collect())
    assert [(r[1], r[2], r[3] >> 16) for r in found] == [(1, 1, 3), (2, 1, 2), (3, 1, 2), (4, 2, 1)]


def test_scores_beyond_64_bits_are_refused(spark):
    table = spark.createDataFrame([(0, [1e18]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        inner_topk.top_inner_products(table, F.col("vec_id") == 0)


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    found = inner_topk.top_inner_products(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 1, 256 * 128), (0, 2, 2, -256 * 256)]
    assert inner_topk.top_inner_products(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0

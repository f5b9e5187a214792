"""SQL that must give the rows of the registered queries."""

from __future__ import annotations

from . import arc_convert, inner_topk, sharding
from . import quality_rules as rules


def quality_rules() -> str:
    steps = "t0"
    chain = []
    for k, (_, pattern) in enumerate(rules.CLASSES):
        chain.append(f"s{k + 1} AS (SELECT *, regexp_replace(t{k}, '{pattern}', '', 'g') AS t{k + 1} FROM s{k})")
    lengths = ", ".join(
        f"(length(t{k}) - length(t{k + 1}))::BIGINT AS c{k}" for k in range(len(rules.CLASSES))
    ) + f", length(t{len(rules.CLASSES)})::BIGINT AS c{len(rules.CLASSES)}"
    width = range(len(rules.CLASSES) + 1)
    names = [name for name, _ in rules.CLASSES]
    space, symbol = names.index("space"), names.index("symbol")
    term = "(0.5 * p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END)"
    return f"""
WITH s0 AS (
  SELECT doc_id, coalesce(text, '') AS {steps},
         CASE WHEN trim(lang) <> '' THEN lang END AS lang,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), {", ".join(chain)},
m AS (
  SELECT doc_id, lang, ws, len(ws) AS n, length(t0) AS chars, {lengths},
         list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM s{len(rules.CLASSES)}
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {rules.WINDOW - 1}), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, n - {rules.WINDOW - 2})) AS i FROM m WHERE n >= {rules.WINDOW})
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM windows) WHERE k > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat
  FROM twice, (SELECT unnest(range({rules.WINDOW})) AS j) GROUP BY doc_id
), words AS (
  SELECT doc_id, lang, rtrim(lower(w), '.,;:!?') AS w FROM (SELECT doc_id, lang, unnest(ws) AS w FROM m)
), doc_words AS (
  SELECT doc_id, lang, w, count(*)::BIGINT AS c FROM words GROUP BY ALL
), lang_sums AS (
  SELECT lang, sum(n) AS words, {", ".join(f"sum(c{k}) AS r{k}" for k in width)}, sum(chars) AS chars
  FROM m WHERE lang IS NOT NULL GROUP BY lang
), refs AS (
  SELECT * FROM lang_sums WHERE chars >= {rules.MIN_REFERENCE_CHARS}
), ref_words AS (
  SELECT d.lang, d.w, sum(d.c) / any_value(r.words)::DOUBLE AS q
  FROM doc_words d JOIN refs r USING (lang) WHERE r.words >= {rules.MIN_REFERENCE_WORDS} GROUP BY d.lang, d.w
  HAVING sum(d.c) * {rules.COMMON_PART} >= any_value(r.words)
), ref_rest AS (
  SELECT lang, 1 - sum(q) AS q FROM ref_words GROUP BY lang
), held AS (
  SELECT d.doc_id, d.c, r.q FROM doc_words d JOIN ref_words r ON r.lang = d.lang AND r.w = d.w
), class_terms AS (
  {" UNION ALL ".join(f"SELECT doc_id, c{k} / m.chars::DOUBLE AS p, r{k} / r.chars::DOUBLE AS q FROM m JOIN refs r USING (lang) WHERE m.chars >= {rules.MIN_CHARS}" for k in width)}
), class_distance AS (
  SELECT doc_id, sqrt(greatest(sum({term}) + 0.5 * greatest(1 - sum(q), 0), 0)) AS d FROM class_terms WHERE p > 0 GROUP BY doc_id
), common_terms AS (
  SELECT h.doc_id, h.c / m.n::DOUBLE AS p, h.q FROM held h JOIN m USING (doc_id) WHERE m.n >= {rules.MIN_JUDGED_WORDS}
  UNION ALL
  SELECT m.doc_id, (m.n - coalesce(x.c, 0)) / m.n::DOUBLE, r.q
  FROM m JOIN ref_rest r USING (lang) LEFT JOIN (SELECT doc_id, sum(c) AS c FROM held GROUP BY doc_id) x USING (doc_id)
  WHERE m.n >= {rules.MIN_JUDGED_WORDS}
), common_distance AS (
  SELECT doc_id, sqrt(greatest(sum({term}) + 0.5 * greatest(1 - sum(q), 0), 0)) AS d FROM common_terms WHERE p > 0 GROUP BY doc_id
), verdicts AS (
  SELECT m.doc_id, m.n::BIGINT AS n_words, (m.chars - c{space})::BIGINT AS word_chars, c{symbol} AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
         a.d AS class_d, b.d AS common_d
  FROM m LEFT JOIN covered USING (doc_id) LEFT JOIN class_distance a USING (doc_id) LEFT JOIN common_distance b USING (doc_id)
), based AS (
  SELECT *, (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM verdicts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_d, 0) <= {rules.MAX_CLASS_DISTANCE}
         AND NOT coalesce(common_d > {rules.MAX_COMMON_DISTANCE} + {rules.COMMON_SLACK} / sqrt(n_words), FALSE) AS kept
FROM based
"""


def archive_pages() -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS holder FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {arc_convert.REVISIT_BYTES} AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {arc_convert.REVISIT_BYTES} AND page_id <> holder THEN holder END AS refers_to
FROM h
"""


def top_inner_products() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({inner_topk.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= {inner_topk.K}
"""


def shards(deepest: int = 24) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, {sharding.BITS // 4}))::BIGINT AS h
  FROM documents
), b AS (
  SELECT depth, h >> ({sharding.BITS} - depth)::BIGINT AS prefix, sum(bytes)::BIGINT AS shard_bytes
  FROM d, (SELECT unnest(range({deepest})) AS depth) GROUP BY ALL
), f AS (
  SELECT d.doc_id, d.bytes, b.depth, b.prefix, b.shard_bytes,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY b.depth) AS k
  FROM d JOIN b ON b.prefix = d.h >> ({sharding.BITS} - b.depth)::BIGINT
  WHERE b.shard_bytes <= {sharding.LIMIT_BYTES}
)
SELECT doc_id, bytes, CASE WHEN depth > 0 THEN right(lpad(bin(prefix), 64, '0'), depth) ELSE '' END AS shard_id,
       depth::INT AS depth, shard_bytes
FROM f WHERE k = 1
"""


def threads() -> str:
    """The truth: every turn was written as a reply to the one before it."""
    return """
SELECT conv_id, turn::BIGINT AS turn,
       lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS parent_turn,
       min(turn) OVER (PARTITION BY conv_id)::BIGINT AS root_turn,
       (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS depth,
       (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS reply_ordinal,
       md5(rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10))) AS own_text_md5
FROM conversations
"""

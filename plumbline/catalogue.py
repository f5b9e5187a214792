"""The registered queries and, for each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import globs, text
from .operators import relational as rel
from .streaming.precheck import verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = sql
        return function

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules over the invented prose; the literals are words that occur in it.
TEXT_RULES = [
    {"name": "no-list-bars", "severity": "warning", "message": "lists belong in tables", "forbidden": [" | "]},
    {"name": "no-shouting", "severity": "warning", "message": "lower the voice", "forbidden": ["!!", "THE "]},
    {"name": "no-junk", "severity": "error", "message": "junk marks", "forbidden": ["###", "$$$", "&&&", "%%%"]},
    {"name": "no-hashes", "severity": "error", "message": "looks like a key", "forbidden": ["[0-9a-f]{32}"], "is_regex": True},
]

_RULES_SQL = """rules(rule, severity, literal, is_regex, rank) AS (VALUES
  ('no-list-bars', 'warning', ' | ', FALSE, 0), ('no-shouting', 'warning', '!!', FALSE, 0),
  ('no-shouting', 'warning', 'THE ', FALSE, 1), ('no-junk', 'error', '###', FALSE, 0),
  ('no-junk', 'error', '$$$', FALSE, 1), ('no-junk', 'error', '&&&', FALSE, 2),
  ('no-junk', 'error', '%%%', FALSE, 3), ('no-hashes', 'error', '[0-9a-f]{32}', TRUE, 0))"""


def _doc_lines(column: str = "text"):
    return F.split(F.coalesce(F.col(column), F.lit("")), "\n")


def _rule_matches(spark, sf_dir):
    return rel.scan_rules(_t(spark, sf_dir, "documents"), TEXT_RULES, ["doc_id"], _doc_lines())


_MATCHES_SQL = f"""WITH {_RULES_SQL},
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
hits AS (SELECT doc_id, line, rule, severity, literal,
                row_number() OVER (PARTITION BY doc_id, line, rule ORDER BY rank) AS k
         FROM lines JOIN rules ON CASE WHEN is_regex THEN regexp_matches(x, literal) ELSE contains(x, literal) END),
matches AS (SELECT * FROM hits WHERE k = 1)"""


@_query(_MATCHES_SQL + " SELECT doc_id, line::INT AS line, rule, severity, literal FROM matches")
def q_rule_scan(spark, sf_dir):
    return _rule_matches(spark, sf_dir).select("doc_id", "line", "rule", "severity", "literal")


@_query(
    _MATCHES_SQL
    + """ SELECT rule, severity, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs,
       count(*) FILTER (severity = 'error') AS n_errors FROM matches GROUP BY rule, severity"""
)
def q_rule_severity(spark, sf_dir):
    return _rule_matches(spark, sf_dir).groupBy("rule", "severity").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.count_distinct("doc_id").alias("n_docs"),
        F.count_if(F.col("severity") == "error").alias("n_errors"),
    )


@_query("""SELECT lang, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc,
           count(*) AS n_docs FROM documents GROUP BY lang""")
def q_loc(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(
        F.sum(text.loc(F.col("text"))).alias("loc"), F.count(F.lit(1)).alias("n_docs")
    )


@_query("""SELECT lang, count(*) AS n_files, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share
           FROM documents GROUP BY lang""")
def q_lang_breakdown(spark, sf_dir):
    counted = _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"))
    total = F.sum("n_files").over(Window.partitionBy(F.lit(0)))  # over a row for each language
    return counted.select("lang", "n_files", F.round(F.col("n_files") * F.lit(100.0) / total, 1).alias("share"))


_TOKENS_SQL = r"""WITH tokens AS (
  SELECT DISTINCT doc_id, x AS token
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN_\pM]+')) AS x FROM documents)
  WHERE regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))"""


def _tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("token"))


@_query(_TOKENS_SQL + " SELECT doc_id, count(*) AS n_tokens FROM tokens GROUP BY doc_id")
def q_tokens(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.size(text.identifiers(F.col("text"))).alias("n"))
    return docs.where("n > 0").groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))


@_query(
    _TOKENS_SQL
    + """ SELECT t.doc_id, t.token FROM tokens t
     WHERE NOT EXISTS (SELECT 1 FROM tokens o WHERE o.token = t.token AND o.doc_id <> t.doc_id)"""
)
def q_dead_tokens(spark, sf_dir):
    return rel.document_frequency_one(_tokens(spark, sf_dir), "doc_id", "token")


@_query(f"""WITH {_RULES_SQL},
hits AS (SELECT c.conv_id, c.turn, r.severity FROM conversations c
         JOIN rules r ON CASE WHEN is_regex THEN regexp_matches(c.text, literal) ELSE contains(c.text, literal) END)
SELECT c.conv_id, c.turn, coalesce(bool_or(h.severity = 'error'), FALSE) AS blocked,
       coalesce(bool_or(h.severity = 'warning'), FALSE) AS warned
FROM conversations c LEFT JOIN hits h ON c.conv_id = h.conv_id AND c.turn = h.turn GROUP BY c.conv_id, c.turn""")
def q_precheck_verdict(spark, sf_dir):
    return verdicts(_t(spark, sf_dir, "conversations"), TEXT_RULES, F.col("text")).select(
        "conv_id", "turn", "blocked", "warned"
    )


_HOST = r"^https?://([^/?#]+)"
_PATH_SQL = r"regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1)"


def _url_path():
    return F.regexp_extract("url", r"^https?://[^/?#]+/?([^?#]*)", 1)


@_query(
    f"""SELECT page_id, concat_ws(',', CASE WHEN regexp_full_match({_PATH_SQL}, '[^/]*/[^/]*') THEN 'two-deep' END,
           CASE WHEN regexp_full_match({_PATH_SQL}, '(?:[^/]+/)*[^/]*5') THEN 'ends-in-5' END,
           CASE WHEN regexp_full_match({_PATH_SQL}, 'en(?:/.*)?') THEN 'english' END) AS patterns
    FROM pages WHERE {_PATH_SQL} IS NOT NULL"""
)
def q_url_glob(spark, sf_dir):
    path = _url_path()
    named = [
        ("two-deep", globs.segments_regex("*/*")),
        ("ends-in-5", globs.path_regex("**/*5")),
        ("english", "^en(?:/.*)?$"),
    ]
    fits = text.reasons(*[(path.rlike(regex), F.lit(name)) for name, regex in named])
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(fits, ",").alias("patterns"))


@_query("""SELECT page_id, CASE WHEN contains(url, '//m.') THEN 'mobile' WHEN contains(url, '//blog.') THEN 'blog'
           WHEN contains(url, '.org') THEN 'org' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS kind FROM pages""")
def q_url_first_match(spark, sf_dir):
    has = lambda part: F.contains("url", F.lit(part))
    kind = text.first_match(
        [(has("//m."), F.lit("mobile")), (has("//blog."), F.lit("blog")), (has(".org"), F.lit("org")), (has("?"), F.lit("query"))],
        F.lit("plain"),
    )
    return _t(spark, sf_dir, "pages").select("page_id", kind.alias("kind"))


@_query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'label:toxic' WHEN l.quality = 0 THEN 'label:low'
           WHEN d.source IN ('src0', 'src1') THEN 'source:' || d.source WHEN d.lang <> 'en' THEN 'lang:' || d.lang
           ELSE 'fallback:unit' END AS kind FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_doc_type(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    kind = text.first_match(
        [
            (F.col("toxic") == 1, F.lit("label:toxic")),
            (F.col("quality") == 0, F.lit("label:low")),
            (F.col("source").isin("src0", "src1"), F.concat(F.lit("source:"), F.col("source"))),
            (F.col("lang") != "en", F.concat(F.lit("lang:"), F.col("lang"))),
        ],
        F.lit("fallback:unit"),
    )
    return docs.select("doc_id", kind.alias("kind"))


@_query("""SELECT p_partkey, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'A') AS a,
           count(DISTINCT l_orderkey) FILTER (l_returnflag = 'N') AS n,
           count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS r
           FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def q_coverage(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey").distinct()
    flags = {"A": "a", "N": "n", "R": "r"}
    covered = items.groupBy("l_partkey").agg(
        *[F.count_if(F.col("l_returnflag") == k).alias(v) for k, v in flags.items()]
    )
    return (
        _t(spark, sf_dir, "part")
        .select("p_partkey")
        .join(covered, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select("p_partkey", *[F.coalesce(v, F.lit(0)).alias(v) for v in flags.values()])
    )


@_query("""SELECT count(*) AS total, count(*) FILTER (covered) AS covered,
           round(count(*) FILTER (covered) / count(*)::DOUBLE * 100, 1) AS coverage_pct
    FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS covered FROM customer)""")
def q_coverage_pct(spark, sf_dir):
    urgent = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    marked = _t(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    covered = F.count_if(F.col("o_custkey").isNotNull())
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        covered.alias("covered"),
        text.percentage(covered, F.count(F.lit(1)), 100.0).alias("coverage_pct"),
    )


@_query("""SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey
           HAVING bool_or(l_returnflag = 'A') AND NOT bool_or(l_returnflag IN ('N', 'R'))""")
def q_unit_only(spark, sf_dir):
    flag = F.col("l_returnflag")
    grouped = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_or(flag == "A").alias("has_a"),
        F.bool_or(flag.isin("N", "R")).alias("has_other"),
    )
    return grouped.where("has_a and not has_other").select("l_orderkey", "n_lines")


@_query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
           (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def q_uncovered(spark, sf_dir):
    urgent = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return (
        _t(spark, sf_dir, "customer")
        .join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .select("c_custkey", "c_name")
    )


@_query(
    _TOKENS_SQL
    + r""" SELECT page_id, count(DISTINCT doc_id) AS n_docs FROM pages
     JOIN (SELECT doc_id, lang, lower(token) AS token FROM tokens JOIN documents USING (doc_id)) t
       ON t.token = lower(regexp_extract(url, '^https?://([^./?#]+)', 1)) AND contains(url, '/' || lang)
     GROUP BY page_id"""
)
def q_fuzzy_match(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.explode(F.array_distinct(F.transform(text.identifiers(F.col("text")), lambda x: F.lower(x)))).alias("token"),
    )
    counted = docs.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))  # one row a language and token
    pages = _t(spark, sf_dir, "pages").select(
        "page_id", "url", F.lower(F.regexp_extract("url", r"^https?://([^./?#]+)", 1)).alias("label")
    )
    named = F.contains("url", F.concat(F.lit("/"), F.col("lang")))
    return pages.join(counted, (F.col("label") == F.col("token")) & named).groupBy("page_id").agg(F.sum("n").alias("n_docs"))


@_query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS dark,
           round(count(*) FILTER (event_type NOT IN ('error', 'signup')) / count(*)::DOUBLE * 100, 1) AS dark_pct
           FROM events GROUP BY user_id""")
def q_dark_functions(spark, sf_dir):
    dark = F.count_if(~F.exists(F.array(F.lit("error"), F.lit("signup")), lambda p: F.startswith(F.col("event_type"), p)))
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), dark.alias("dark"), text.percentage(dark, F.count(F.lit(1)), 0.0).alias("dark_pct")
    )


@_query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events FROM events GROUP BY ALL
           HAVING NOT bool_or(event_type = 'purchase')""")
def q_dark_modules(spark, sf_dir):
    return (
        _t(spark, sf_dir, "events")
        .groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.bool_or(F.col("event_type") == "purchase").alias("lit"))
        .where("not lit")
        .select("user_id", "day", "n_events")
    )


@_query("""WITH o AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws('; ', CASE WHEN n >= 6 THEN n || ' lines (max 6)' END,
       CASE WHEN q >= 150 THEN q::BIGINT || ' pieces (max 150)' END) AS reasons
FROM o WHERE n >= 6 OR q >= 150""")
def q_god_files(spark, sf_dir):
    sized = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")
    )
    why = text.reasons(
        (F.col("n") >= 6, F.concat(F.col("n").cast("string"), F.lit(" lines (max 6)"))),
        (F.col("q") >= 150, F.concat(F.col("q").cast("long").cast("string"), F.lit(" pieces (max 150)"))),
    )
    return (
        sized.withColumn("why", why)
        .where(F.size("why") > 0)
        .select("l_orderkey", F.array_join("why", "; ").alias("reasons"))
    )


@_query("""SELECT n_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey
           GROUP BY n_name HAVING count(*) >= 5""")
def q_god_classes(spark, sf_dir):
    return (
        _t(spark, sf_dir, "supplier")
        .join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count(F.lit(1)).alias("n_suppliers"))
        .where("n_suppliers >= 5")
    )


@_query("""SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS layers, count(DISTINCT p_type) AS n_layers
           FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) >= 2""")
def q_layers(spark, sf_dir):
    return (
        _t(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))
        .where(F.size("kinds") >= 2)
        .select("p_brand", F.array_join("kinds", ",").alias("layers"), F.size("kinds").cast("long").alias("n_layers"))
    )


@_query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_mktsegment = 'BUILDING' THEN 'medium' ELSE 'high' END
           AS confidence FROM customer WHERE c_acctbal >= 0""")
def q_confidence(spark, sf_dir):
    ladder = F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_mktsegment") == "BUILDING", "medium").otherwise("high")
    rank = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return (
        _t(spark, sf_dir, "customer").withColumn("confidence", ladder).where(rank >= 1).select("c_custkey", "confidence")
    )


@_query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey AS k, epoch(l_shipdate)::BIGINT // 86400 AS a FROM lineitem)
SELECT x.l_orderkey, x.l_linenumber FROM s x WHERE x.l_returnflag <> 'R' AND EXISTS
  (SELECT 1 FROM s y WHERE y.l_returnflag = 'R' AND y.k = x.k AND x.a <= y.a + 5 AND x.a + 5 >= y.a)""")
def q_overlap(spark, sf_dir):
    spans = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_suppkey",
        F.floor(F.unix_timestamp("l_shipdate") / 86400).alias("a"),
    ).withColumn("b", F.col("a") + 5)
    found = rel.overlap_semi(spans.where("l_returnflag <> 'R'"), spans.where("l_returnflag = 'R'"), "l_suppkey", "a", "b")
    return found.select("l_orderkey", "l_linenumber")


@_query("""SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS
  (SELECT 1 FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R') b
   WHERE b.l_partkey = a.l_partkey AND b.l_orderkey <> a.l_orderkey)""")
def q_ref_graph(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem")
    owners = items.where("l_returnflag = 'R'").select("l_partkey", "l_orderkey")
    refs = items.select("l_orderkey", "l_linenumber", "l_partkey")
    return rel.other_owner_semi(refs, owners, "l_partkey", "l_orderkey").select("l_orderkey", "l_linenumber")


def _edges(spark, sf_dir):
    """Suppliers lead to the parts they ship, parts (as negative numbers) to suppliers they came back from."""
    items = _t(spark, sf_dir, "lineitem")
    out = items.select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst"))
    back = items.where("l_returnflag = 'R'").select((-F.col("l_partkey")).alias("src"), F.col("l_suppkey").alias("dst"))
    return out.unionByName(back).distinct()


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, -l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT -l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def q_bfs_depth(spark, sf_dir):
    return rel.bounded_reach(_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), 3)


@_query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def q_first_visitor(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rel.first_visitor(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@_query("""WITH changed AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000),
callers AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
covered AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49)
SELECT changed.c AS changed, count(*) AS n_callers, count(*) FILTER (covered.s IS NULL) AS n_uncovered
FROM changed JOIN callers USING (c) LEFT JOIN covered USING (s) GROUP BY changed.c""")
def q_blast_radius(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    changed = orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_custkey").alias("changed")).distinct()
    ordered = orders.join(changed, F.col("o_custkey") == F.col("changed")).select("changed", "o_orderkey")
    callers = items.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).select("changed", "l_suppkey").distinct()
    covered = items.where("l_returnflag = 'A' and l_quantity > 49").select(F.col("l_suppkey").alias("s")).distinct()
    return callers.join(covered, F.col("l_suppkey") == F.col("s"), "left").groupBy("changed").agg(
        F.count(F.lit(1)).alias("n_callers"), F.count_if(F.col("s").isNull()).alias("n_uncovered")
    )


@_query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup FROM events""")
def q_forward_fill(spark, sf_dir):
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    filled = rel.forward_fill(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], value, "last_signup")
    return filled.select("event_id", "last_signup")


@_query("""WITH want(seg) AS (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')),
have AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000)
SELECT n_name, string_agg(seg, ',' ORDER BY seg) AS missing FROM nation CROSS JOIN want
LEFT JOIN have ON c_nationkey = n_nationkey AND c_mktsegment = seg WHERE c_mktsegment IS NULL GROUP BY n_name""")
def q_missing_children(spark, sf_dir):
    required = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    have = (
        _t(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("have"))
    )
    missing = F.array_except(required, F.coalesce("have", F.array().cast("array<string>")))
    return (
        _t(spark, sf_dir, "nation")
        .join(have, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select("n_name", F.array_join(missing, ",").alias("missing"))
        .where("missing <> ''")
    )


@_query(r"""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n_pages,
  count(DISTINCT regexp_extract(url, '^https?://[^/?#]+/?([^/?#]*)', 1)) AS n_children FROM pages GROUP BY host""")
def q_child_counts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", _HOST, 1).alias("host")).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_distinct(F.regexp_extract("url", r"^https?://[^/?#]+/?([^/?#]*)", 1)).alias("n_children"),
    )


@_query("""SELECT 'poor_customer' AS type, c_custkey AS id, c_acctbal AS amount, NULL AS name FROM customer WHERE c_acctbal < -900
UNION ALL SELECT 'big_order', o_orderkey, NULL, NULL FROM orders WHERE o_totalprice > 450000
UNION ALL SELECT 'odd_part', p_partkey, NULL, p_name FROM part WHERE p_size = 1""")
def q_issue_union(spark, sf_dir):
    poor = _t(spark, sf_dir, "customer").where("c_acctbal < -900").select(
        F.lit("poor_customer").alias("type"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")
    )
    big = _t(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.lit("big_order").alias("type"), F.col("o_orderkey").alias("id"))
    odd = _t(spark, sf_dir, "part").where("p_size = 1").select(
        F.lit("odd_part").alias("type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")
    )
    return rel.union_issues(poor, big, odd)

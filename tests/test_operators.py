from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.functions import globs, text
from plumbline.operators import relational as rel
from plumbline.sources import tree
from plumbline.streaming import precheck


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.mark.parametrize(
    "regex, path, fits",
    [
        (globs.path_regex("lib/**/*.dart"), "lib/a.dart", True),
        (globs.path_regex("lib/**/*.dart"), "lib/x/y/a.dart", True),
        (globs.path_regex("lib/**/*.dart"), "test/a.dart", False),
        (globs.path_regex("**/*.py"), "a.py", True),
        (globs.path_regex("**/*"), "x/y", True),
        (globs.path_regex("src/*.py"), "src/x/a.py", False),
        (globs.segments_regex("lib/features/*"), "lib/features/auth", True),
        (globs.segments_regex("lib/features/*"), "lib/features/auth/data", False),
        (globs.segments_regex("lib\\pages/"), "lib/pages", True),
        (globs.filename_regex("*_screen.dart"), "home_screen.dart", True),
        (globs.filename_regex("a?[0-9].[!p]y"), "ab7.zy", True),
        (globs.filename_regex("a?[0-9].[!p]y"), "ab7.py", False),
    ],
)
def test_globs(spark, regex, path, fits):
    assert spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(regex)).first()[0] is fits


def test_text_functions(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("x\x0cy",)], "s string")
    assert [tuple(r) for r in df.select(text.loc(F.col("s")), text.source_lines(F.col("s"))).collect()] == [
        (3, ["a", "b"]),
        (1, []),
        (1, ["x", "y"]),
    ]
    p = spark.createDataFrame([("a/b/c.spec.ts",), ("x",), (".env",)], "p string")
    assert [tuple(r) for r in p.select(text.basename(F.col("p")), text.stem(F.col("p")), text.suffix(F.col("p")), text.parent(F.col("p"))).collect()] == [
        ("c.spec.ts", "c.spec", ".ts", "a/b"),
        ("x", "x", "", ""),
        (".env", ".env", "", ""),
    ]


def test_scan_rules_takes_the_first_literal(spark):
    docs = spark.createDataFrame([(1, "say FIXME TODO\nok\n TODO "), (2, None)], "id int, body string")
    rules = [
        {"name": "todo", "severity": "warning", "message": "m", "forbidden": ["TODO", "FIXME"]},
        {"name": "num", "severity": "error", "message": "m", "forbidden": [r"o\w$"], "is_regex": True},
    ]
    found = rel.scan_rules(docs, rules, ["id"], F.split(F.coalesce("body", F.lit("")), "\n"))
    assert rows(found, "id", "line", "rule", "literal", "matched") == [
        (1, 1, "todo", "TODO", "say FIXME TODO"),
        (1, 2, "num", r"o\w$", "ok"),
        (1, 3, "todo", "TODO", "TODO"),
    ]
    assert rel.scan_rules(docs, [], ["id"], F.split("body", "\n")).count() == 0


def test_overlap(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("b", 1, 1), ("a", 1, 5), (None, 1, 5), ("a", 7, None)], "k string, s int, e int")
    right = spark.createDataFrame([("a", 5, 5), ("a", 4, 6), ("b", 2, 3), ("a", None, 9)], "k string, s int, e int")
    assert rows(rel.overlap_semi(left, right, "k", "s", "e")) == [("a", 1, 5), ("a", 1, 5), ("a", 6, 9)]


def test_overlap_equals_brute_force(spark):
    rng = random.Random(2)
    spans = lambda n: [(rng.choice("aaab"), s := rng.randrange(300), s + rng.randrange(6)) for _ in range(n)]
    one, two = spans(200), spans(60)
    made = lambda x: spark.createDataFrame(x, "k string, s int, e int")
    expected = sorted(x for x in one if any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in two))
    assert rows(rel.overlap_semi(made(one), made(two), "k", "s", "e")) == expected


@pytest.mark.parametrize("how, merge", [("last", lambda xs: xs[-1]), ("max", max), ("sum", sum)])
@pytest.mark.parametrize("keyed, spread, current", [(True, True, True), (True, False, True), (True, True, False), (False, True, True)])
def test_running_values(spark, how, merge, keyed, spread, current):
    rng = random.Random(3)
    table = [(k, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, None, rng.randrange(99)])) for k in range(300)]
    df = spark.createDataFrame(table, "n int, k string, v int").repartition(5)
    found = rel.running(df, ["k"] if keyed else [], ["n"], F.col("v"), "r", how, spread, current)
    assert found.columns == ["n", "k", "v", "r"]
    expected = []
    for n, k, v in table:
        before = [x for m, j, x in table if (j == k or not keyed) and (m < n or m == n and current) and x is not None]
        expected.append((n, k, v, merge(before) if before else None))
    assert sorted(map(str, found.collect())) == sorted(str(Row(n=n, k=k, v=v, r=r)) for n, k, v, r in expected)
    assert rel.running(df.limit(0), ["k"], ["n"], F.col("v"), "r", how, spread).count() == 0


def test_many_rules(spark):
    rules = [{"name": f"r{k}", "severity": "error", "message": "m", "forbidden": [f"<{k}>"]} for k in range(1001)]
    docs = spark.createDataFrame([(1, "<7> <1000>"), (2, "x")], "id int, body string")
    assert rows(rel.scan_rules(docs, rules, ["id"], F.split("body", "\n")), "id", "rule") == [(1, "r1000"), (1, "r7")]


def test_reach_ends_by_itself(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(9, 0)], "src int, dst int")
    assert rows(rel.bounded_reach(edges, spark.createDataFrame([(3,)], "node int")), "node", "depth") == sorted(((3 + d) % 10, d) for d in range(10))


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    reach = rel.bounded_reach(edges, spark.createDataFrame([(1,)], "node int"), 3)
    assert rows(reach, "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_single_document_tokens(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "c")], "d int, t string")
    assert rows(rel.document_frequency_one(tokens, "d", "t")) == [(1, "a"), (2, "c")]


def test_plans(spark):
    left = spark.range(10).withColumn("n", F.col("id") % 3)
    plan = rel.other_owner_semi(left, left, "n", "id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_diff_forward_fill(spark):
    diff = "+++ b/x.py\n@@ -1 +1 @@\n@@ -5,2 +7,0 @@\n+++ /dev/null\n@@ -1 +1,2 @@\n+++ b/y.py\t2020\n@@ -3,1 +4,3 @@ f()"
    found = tree.parse_diff(spark.createDataFrame([(1, diff)], "diff_id int, text string"))
    assert rows(found) == [("x.py", 1, 1), ("y.py", 4, 6)]


RULES = tree.content_rules("python")


@pytest.mark.parametrize(
    "event, code",
    [
        ({"tool_name": "Write", "tool_input": {"file_path": "src/a.py", "content": "x = 1"}}, 0),
        ({"tool_name": "Write", "tool_input": {"file_path": "src/a.py", "content": "try:\n  pass\nexcept:\n"}}, 2),
        ({"tool_name": "Write", "tool_input": {"file_path": "src/a.py", "content": "print(1)"}}, 0),
        ({"tool_name": "Edit", "tool_input": {"file_path": "src/a.py", "new_string": "token = 1"}}, 2),
        ({"tool_name": "Read", "tool_input": {"file_path": "src/a.py", "content": "token = 1"}}, 0),
        ({"tool_name": "Write", "tool_input": {"file_path": "src/a.rs", "content": "token = 1"}}, 0),
        ({"tool_name": "Write", "tool_input": {"file_path": "src/a.py", "content": ""}}, 0),
        ("{not json", 0),
    ],
)
def test_precheck(spark, event, code):
    line = event if isinstance(event, str) else json.dumps(event)
    found = precheck.check_stream(spark.createDataFrame([(line,)], "value string"), RULES).collect()
    assert [r.exit_code for r in found] == [code]


def test_precheck_stream(spark, tmp_path):
    events = [{"tool_name": "Write", "tool_input": {"file_path": f"src/{k}.py", "content": "except:" if k % 2 else "ok"}} for k in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, events)))
    checked = precheck.check_stream(spark.readStream.text(str(tmp_path / "in")), RULES)
    query = (
        checked.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(60)
    assert rows(spark.table("verdicts"), "path", "exit_code") == [(f"src/{k}.py", 2 * (k % 2)) for k in range(4)]


def test_queries_agree_with_their_sql(spark):
    import importlib.util
    from pathlib import Path

    import duckdb

    from plumbline import catalogue

    assert importlib.util.find_spec("duckdb")
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for path in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    for name in ("q_rule_scan", "q_dead_tokens", "q_overlap", "q_bfs_depth", "q_blast_radius"):
        mine = catalogue.QUERIES[name](spark, str(data))
        result = con.execute(catalogue.ORACLE[name])
        order = [c[0] for c in result.description]
        assert sorted(map(str, rows(mine, *order))) == sorted(str(tuple(r)) for r in result.fetchall()), name

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.plans import detect, reports


@pytest.mark.parametrize(
    "files, expected, stack, preset",
    [
        ({"pubspec.yaml": "flutter_riverpod: 2", "docker-compose.yml": "image: postgres"}, ("flutter", "riverpod", None, "postgres", "flutter-riverpod-pg"), "flutter-riverpod", "flutter"),
        ({"app/pubspec.yaml": "flutter_bloc: 8", "db/migrations/1.sql": "-- PostgreSQL"}, ("flutter", "bloc", None, "postgres", "flutter-bloc-pg"), "flutter-bloc", "flutter"),
        ({"pubspec.yaml": "dependencies:\n  GetX: 1"}, ("flutter", "getx", None, None, None), None, "flutter"),
        ({"pyproject.toml": '[project]\ndependencies = ["FastAPI[all]>=1", "asyncpg==1"]'}, (None, None, "fastapi", "postgres", None), "fastapi", "python"),
        ({"api/Cargo.toml": '[dependencies]\naxum = "1"\nrusqlite = "1"'}, (None, None, "axum", "sqlite", None), "axum", "rust"),
        ({"package.json": json.dumps({"dependencies": {"next": "1", "@trpc/server": "1"}}), "docker-compose.yaml": "postgres"}, ("nextjs", None, "trpc", "postgres", "next-trpc-pg"), None, "general"),
        ({"package.json": "{broken", "pyproject.toml": "also ["}, (None, None, None, None, None), None, "python"),
        ({}, (None, None, None, None, None), None, "general"),
    ],
)
def test_stacks(tmp_path, files, expected, stack, preset):
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = detect.detect(tmp_path)
    assert (found.frontend, found.state_management, found.backend, found.database, found.template) == expected
    assert (found.description == "unknown stack") == (not any(expected))
    assert detect.default_stack(tmp_path) == stack and detect.default_preset(tmp_path) == preset


def test_root():
    assert detect.infer_root("/a/b/lib/x.dart") == "/a/b" and detect.infer_root("lib/x.dart") is None


def test_presets_and_names(spark):
    assert {r.preset: r["count"] for r in reports.presets(spark).groupBy("preset").count().collect()} == {"flutter": 19, "python": 5, "rust": 4, "general": 2}
    row = spark.createDataFrame([("my cool-app",)], "n string").select(
        text.pascal(F.col("n")), text.snake(F.col("n")), text.rendered(F.lit("x {{a}} {{b}}"), {"a": F.col("n")})
    )
    assert tuple(row.first()) == ("MyCoolApp", "my_cool_app", "x my cool-app {{b}}")


def test_order_and_graph(spark):
    dead = spark.createDataFrame([("b", "low"), ("a", "low"), ("z", "high")], "symbol string, confidence string")
    assert [r.symbol for r in reports.in_order("dead_code", dead).collect()] == ["z", "a", "b"]
    rows = [("f", "x.py", "direct", "g", "y.py", 1, True), ("f", "x.py", "transitive", "g", "y.py", 1, True)]
    callers = spark.createDataFrame(rows, "changed string, changed_path string, relation string, caller string, caller_path string, caller_line int, is_covered boolean")
    nodes, edges = reports.change_graph(callers)
    assert sorted(tuple(r) for r in nodes.collect()) == [("f", "x.py", "changed"), ("g", "y.py", "direct")]
    assert [tuple(r) for r in edges.collect()] == [("g", "f", "covered")]

from __future__ import annotations

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.plans import analyzers as an
from plumbline.plans.testtypes import classify
from plumbline.plans.views import Views
from plumbline.sources import parse, sinks, tree

SHOP = {
    "src/shop/cart.py": '''import logging

logger = logging.getLogger(__name__)


class Cart:
    def __init__(self):
        self.items = []

    def add(self, item):
        logger.info("added")
        self.items.append(item)

    def total(self):
        return sum(self.items)


def checkout(cart):
    password = "x"
    print("TODO later")
    return cart.total()


def _audit(cart):
    return cart
''',
    "src/shop/report.py": "from shop.cart import checkout\n\n\ndef monthly(cart):\n    return checkout(cart)\n",
    "src/broken.py": "def fine():\n    pass\n\nclass Half:\n    def cut(self:\n",
    "tests/integration/test_cart.py": "from shop.cart import Cart\n\n\ndef test_add():\n    Cart().add(1)\n",
    "build/out.py": "def skipped():\n    pass\n",
    "web/page.ts": "import x from 'y'\n",
    "lib/pages/home_page.dart": """import 'package:dio/dio.dart';

class HomePage extends StatelessWidget {
  Widget build(BuildContext context) {
    print('hi');
    return Text('x');
  }
}

class UserRepository {
  Future<void> load() async {
    log('x');
  }
}
""",
    "src/main.rs": """pub struct Point { x: i32 }

impl Point {
    pub async fn shift(&mut self, by: i32) {
        tracing::info!("shift");
        self.x += by;
    }
    fn hidden(&self) -> i32 { self.x }
}

fn main() {
    Point { x: 1 }.hidden().unwrap();
}
""",
}


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, body in SHOP.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body, encoding="utf-8")
    (root / "lib/features/auth").mkdir(parents=True)
    return Views.scan(spark, str(root))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scan(views):
    assert rows(views.files, "path", "lang", "loc", "is_test") == [
        ("lib/pages/home_page.dart", "dart", 15, False),
        ("src/broken.py", "python", 6, False),
        ("src/main.rs", "rust", 14, False),
        ("src/shop/cart.py", "python", 26, False),
        ("src/shop/report.py", "python", 6, False),
        ("tests/integration/test_cart.py", "python", 6, True),
        ("web/page.ts", "typescript", 2, False),
    ]


def test_symbols(views):
    found = views.symbols
    assert rows(found.where("path = 'src/shop/cart.py'"), "symbol_ord", "name", "kind", "parent_class", "line_start", "is_public") == [
        (0, "Cart", "class", None, 6, True),
        (1, "__init__", "method", "Cart", 7, False),
        (2, "add", "method", "Cart", 10, True),
        (3, "total", "method", "Cart", 14, True),
        (4, "checkout", "function", None, 18, True),
        (5, "_audit", "function", None, 24, False),
    ]
    assert rows(found.where("path = 'src/broken.py'"), "name", "kind") == [("Half", "class"), ("cut", "method"), ("fine", "function")]
    assert rows(found.where("lang = 'rust'"), "name", "kind", "parent_class", "is_async", "is_public", "line_start", "line_end") == [
        ("Point", "class", None, False, True, 1, 1),
        ("hidden", "method", "Point", False, False, 8, 8),
        ("main", "function", None, False, False, 11, 13),
        ("shift", "method", "Point", True, True, 4, 7),
    ]
    assert rows(found.where("lang = 'dart'"), "name", "kind", "parent_class", "is_async") == [
        ("HomePage", "class", None, False),
        ("UserRepository", "class", None, False),
        ("build", "method", "HomePage", False),
        ("load", "method", "UserRepository", True),
    ]


def test_decorators_and_nesting():
    source = "@dec(1)\nclass A:\n    @staticmethod\n    async def f():\n        def inner(): pass\n    class B:\n        pass\nif True:\n    def g(): pass\n"
    found = [r for r in parse.parse_source(source, "python") if r[0] == "symbol"]
    assert [(r[2], r[3], r[4], r[7], r[8], r[9]) for r in found] == [
        ("A", "class", 1, ["dec"], None, False),
        ("f", "method", 4, ["staticmethod"], "A", True),
        ("B", "class", 6, [], "A", False),
        ("g", "function", 9, [], None, False),
    ]


def test_references():
    source = "import a.b\nimport c as d\nfrom m import X as Y, Z\nf()\no.m()\n"
    assert [r[2] for r in parse.parse_source(source, "python") if r[0] == "ref"] == ["Y", "Z", "a", "d", "f", "m"]


def test_coverage(views):
    result = an.Coverage().analyze(views)
    uncovered = {r.symbol for r in result.issues.collect()}
    # test_cart refers to Cart, whose file is called cart: that covers the whole file
    assert {"Cart", "add", "checkout", "total"}.isdisjoint(uncovered) and {"monthly", "fine", "main"} <= uncovered
    assert result.summary.first()[0] == "33.3% coverage — 12 uncovered symbols"
    table = an.coverage_table(views).where("name = 'add'").first()
    assert (table.integration, table.unit, table.total_tests) == (1, 0, 1)
    assert an.unit_only(views).count() == 0


def test_observability(views):
    result = an.Observability().analyze(views)
    dark = {r.symbol for r in result.issues.collect()}
    assert dark == {"total", "checkout", "monthly", "fine", "cut", "build"}
    assert "dark functions, 2 dark modules" in result.summary.first()[0]
    assert rows(an.dark_modules(views), "path") == [("src/broken.py",), ("src/shop/report.py",)]
    more = an.Observability({"python": ["sum"]}).analyze(views)
    assert "total" not in {r.symbol for r in more.issues.collect()}


def test_solid(views):
    result = an.Solid().analyze(views)
    assert rows(result.issues, "type", "file", "reason") == [
        ("soc_violation", "lib/pages/home_page.dart", "Multiple concern layers co-located (data, ui): HomePage (ui), UserRepository (data)")
    ]
    assert result.summary.first()[0] == "1 issues — 0 god files, 0 god classes, 1 SoC violations"


def test_god_class(spark):
    body = "class Big:\n" + "".join(f"    def m{k}(self): pass\n" for k in range(21))
    files = tree.files_table(spark.createDataFrame([("a/big.py", body)], "path string, source string"))
    found = an.Solid().analyze(Views.of(files)).issues
    assert {r.type for r in found.collect()} == {"god_file", "god_class"}
    assert found.where("type = 'god_class'").first().method_count == 21


def test_dead_code(views):
    high = rows(an.DeadCode().analyze(views).issues, "symbol", "confidence")
    assert high == [("Half", "high"), ("HomePage", "high"), ("Point", "high"), ("UserRepository", "high"), ("_audit", "medium"), ("fine", "high"), ("monthly", "high")]
    low = {r.symbol for r in an.DeadCode("low").analyze(views).issues.collect()}
    assert {"total", "shift"} <= low and "__init__" not in low and "add" not in low
    assert "monthly" not in {r.symbol for r in an.DeadCode(entry_points=("monthly",)).analyze(views).issues.collect()}


def test_rules(views):
    python = an.RepoRules(tuple(tree.content_rules("python"))).analyze(views)
    assert rows(python.issues, "file", "line", "rule", "severity", "matched") == [
        ("src/shop/cart.py", 19, "no-hardcoded-secrets", "error", 'password = "x"'),
        ("src/shop/cart.py", 20, "no-print-debug", "warning", 'print("TODO later")'),
    ]
    assert python.summary.first()[0] == "1 errors, 1 warnings (3 files, 5 rules)"
    taxonomy = an.Taxonomy(tuple(tree.taxonomy_rules("flutter-riverpod"))).analyze(views)
    assert [tuple(r) for r in taxonomy.issues.select("file", "reasons").collect()] == [
        ("lib/pages/home_page.dart", ["forbidden import: dio"])
    ]
    folders = an.FolderStructure(tuple(tree.folder_rules("flutter-riverpod"))).analyze(views)
    assert [(r.folder, len(r.reasons)) for r in folders.issues.orderBy("folder").collect()] == [
        ("lib/features/auth", 3),
        ("lib/pages", 1),
    ]


def test_new_file_limit(spark, views):
    rules = ({"pattern": "src/shop", "max_files": 2, "required_children": ["x"], "message": "m"},)
    proposed = spark.createDataFrame([("src/shop/new.py",)], "path string")
    found = an.FolderStructure(rules).check_new_files(proposed, views.folders).collect()
    assert [r.reasons for r in found] == [["3 files exceeds limit of 2"]]


DIFF = """diff --git a/src/shop/cart.py b/src/shop/cart.py
--- a/src/shop/cart.py
+++ b/src/shop/cart.py
@@ -18,2 +18,3 @@
+x
@@ -30 +40,0 @@
-gone
"""


def test_blast_radius(spark, views):
    hunks = tree.parse_diff(spark.createDataFrame([(1, DIFF)], "diff_id int, text string"))
    assert rows(hunks, "path", "start", "end") == [("src/shop/cart.py", 18, 20)]
    result = an.BlastRadius(hunks).analyze(views)
    assert rows(result.issues, "changed_symbol", "caller", "caller_file") == [("checkout", "monthly", "src/shop/report.py")]
    assert result.summary.first()[0] == "1 symbols changed, 1 callers affected, 1 with no test coverage"


@pytest.mark.parametrize(
    "path, imports, markers, kind, signal",
    [
        ("tests/unit/test_a.py", [], [], "unit", "path:unit"),
        ("tests/unit/test_a.py", [], ["@pytest.mark.e2e"], "e2e", "marker:@pytest.mark.e2e"),
        ("tests/test_x.py", [], ["pytest.mark.slow"], "integration", "marker:pytest.mark.slow"),
        ("tests/test_community.py", [], [], "unit", "path:test_community.py"),
        ("tests/test_x.py", ["playwright.sync_api"], [], "e2e", "import:playwright"),
        ("tests/test_x.py", ["os"], [], "unit", "fallback:unit"),
        ("tests/Security/test_x.py", [], [], "security", "path:security"),
    ],
)
def test_classifier(spark, path, imports, markers, kind, signal):
    row = spark.createDataFrame([(path, imports, markers)], "p string, i array<string>, m array<string>").select(
        classify(F.col("p"), F.col("i"), F.col("m")).alias("c")
    ).first()
    assert (row.c.primary, row.c.signals) == (kind, [signal])


def test_json_and_selection(views):
    results = an.run(views, an.default_analyzers("flutter-riverpod", "python"), only=["solid", "metrics"])
    assert set(results) == {"solid", "metrics"}
    out = io.StringIO()
    sinks.write_report(results, out)
    report = json.loads(out.getvalue())
    assert report["metrics"]["summary"].startswith("7 files, 75 lines")
    assert {i["type"] for i in report["solid"]["issues"]} >= {"soc_violation"}
    assert len(report["solid"]["issues"]) == results["solid"].issues.count()
    totals = {r.analyzer: r.n_issues for r in an.issue_totals(results).collect()}
    assert totals == {k: len(report[k]["issues"]) for k in report} | {"all": sum(len(report[k]["issues"]) for k in report)}


def test_empty_folders_are_listed(spark, tmp_path):
    for name in ("a/b/c", "node_modules/x", "d"):
        (tmp_path / name).mkdir(parents=True)
    assert {r.folder for r in tree.listed_folders(spark, str(tmp_path)).collect()} == {"a", "a/b", "a/b/c", "d"}
    assert tree.listed_folders(spark, str(tmp_path / "none")).count() == 0


def test_git_diffs(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    spans = lambda diff: [tuple(r) for r in tree.parse_diff(diff).collect()]
    assert spans(tree.git_diff(spark, tmp_path)) and not spans(tree.git_diff(spark, tmp_path, None))
    git("add", ".")
    assert spans(tree.git_diff(spark, tmp_path, None))[0][0] == "a.py"


def test_load_analyzer():
    assert an.load_analyzer("plumbline.plans.analyzers.Solid").name == "solid"
    with pytest.raises(TypeError):
        an.load_analyzer("builtins.object")


def test_load_rules(tmp_path):
    config = tmp_path / "rules.toml"
    config.write_text(
        'repo_rules_presets = ["rust"]\n[taxonomy]\nstack = "fastapi"\n[[repo_rules]]\nname = "n"\npattern = "**/*"\nforbidden_content = ["x"]\n[[rules]]\npurpose = "no pattern"\n'
    )
    found = tree.load_rules(config)
    assert len(found["taxonomy"]) == 4 and len(found["folders"]) == 3 and len(found["content"]) == 5
    assert tree.load_rules(tmp_path / "none.toml") == {"taxonomy": [], "folders": [], "content": []}

"""Source trees, diffs, rule files and write events as tables."""

from __future__ import annotations

import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_rules as fixed
from ..functions import globs, text
from ..operators import relational as rel
from ..storage import keep

FILES_SCHEMA = "path string, lang string, loc int, is_test boolean, source string, imports array<string>"
#: Folders that the driver lists before it writes them.
LISTED_AT_ONCE = 50_000


def is_test_path(path):
    """A test folder among the components, or a test name (both as the path is written below the root)."""
    stem = F.lower(text.stem(path))
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in fixed.TEST_FOLDERS])) | (
        F.startswith(stem, F.lit("test_")) | F.endswith(stem, F.lit("_test")) | F.endswith(stem, F.lit(".spec"))
    )


def files_table(sources: DataFrame) -> DataFrame:
    """``files`` from ``(path, source)`` rows; other languages and ignored folders are left out."""
    languages = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    ignored = F.array(*[F.lit(x) for x in fixed.IGNORED])
    path = F.col("path")
    return (
        sources.where(~F.arrays_overlap(F.split(path, "/"), ignored))
        .withColumn("lang", F.try_element_at(languages, text.suffix(path)))
        .where("lang is not null")
        .select(
            "path",
            "lang",
            text.loc(F.col("source")).cast("int").alias("loc"),
            is_test_path(path).alias("is_test"),
            "source",
            F.array().cast("array<string>").alias("imports"),
        )
    )


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``files`` of a directory tree in any store that Spark reads; paths are below ``root``.

    The suffix filter sits on the listing, so other files are not opened.
    """
    suffixes = ",".join(s.lstrip(".") for s in fixed.LANGUAGES)
    read = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{%s}" % suffixes)
        .load(root)
    )
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    base = base.replace("file:///", "file:/")
    below = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(base) + 2, 1 << 20)
    return files_table(read.select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("source")))


def folders_table(files: DataFrame, root: str | None = None) -> DataFrame:
    """``(path, n_files, children)``: direct source files and subfolders of each folder below the root.

    Folders follow from file paths; with a ``root``, in any store that Spark
    reads, those without source files are listed too.
    """
    spark = files.sparkSession
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    own = files.select(text.parent(F.col("path")).alias("folder")).where("folder <> ''").groupBy("folder").count()
    folders = files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("folder"))
    if root:
        folders = folders.unionByName(listed_folders(spark, root))
    ignored = F.array(*[F.lit(x) for x in fixed.IGNORED_FOLDERS])
    folders = folders.where(~F.arrays_overlap(F.split("folder", "/"), ignored)).distinct()
    inside = (
        folders.select(text.parent(F.col("folder")).alias("up"), text.basename(F.col("folder")).alias("name"))
        .groupBy("up")
        .agg(F.array_sort(F.collect_set("name")).alias("children"))
    )
    return (
        folders.join(own, "folder", "left")
        .join(inside, F.col("folder") == F.col("up"), "left")
        .select(
            F.col("folder").alias("path"),
            F.coalesce("count", F.lit(0)).alias("n_files"),
            F.coalesce("children", F.array().cast("array<string>")).alias("children"),
        )
    )


def listed_folders(spark: SparkSession, root: str) -> DataFrame:
    """``(folder)``: every folder below ``root``, empty ones too, as the store lists them.

    Level by level from the driver; each level's names go to the table in
    slices, so the driver never holds a tree's folders at once.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, slice_, open_ = spark.createDataFrame([], "folder string"), [], [("", base)]
    while open_:
        below, path = open_.pop()
        if not system.exists(path):
            continue
        for status in system.listStatus(path):
            name = status.getPath().getName()
            if status.isDirectory() and name not in fixed.IGNORED_FOLDERS:
                inner = f"{below}/{name}" if below else name
                slice_.append((inner,))
                open_.append((inner, status.getPath()))
        if slice_ and (len(slice_) >= LISTED_AT_ONCE or not open_):
            found, slice_ = found.unionByName(keep(spark.createDataFrame(slice_, "folder string"), "folders")), []
    return found


def git_diff(spark: SparkSession, root: str | Path, base: str | None = "HEAD") -> DataFrame:
    """``(diff_id, text)`` of a work tree against ``base``, or of what is staged where that is None."""
    against = [base] if base else ["--cached"]
    run = subprocess.run(["git", "diff", "--no-color", *against], cwd=root, capture_output=True, text=True, check=True)
    return spark.createDataFrame([(0, run.stdout)], "diff_id int, text string")


def parse_diff(diffs: DataFrame) -> DataFrame:
    """``(path, start, end)`` of a unified diff's new-side hunks, from ``(diff_id, text)`` rows.

    The current file is carried forward over a diff's lines, whose order a
    diff of any size may be dealt by; a hunk without a count has one line, one
    of no lines is dropped.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    target = F.when(F.col("line").rlike(r"^\+\+\+ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t\r]*)", 1))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    count = F.regexp_extract("line", hunk, 2)
    marked = lines.withColumn("target", target).where(F.col("target").isNotNull() | F.col("line").rlike(hunk))
    return (
        rel.forward_fill(marked, "diff_id", ["pos"], F.col("target"), "path", spread=True)
        .where(F.col("line").rlike(hunk) & F.col("path").isNotNull() & (F.col("path") != "/dev/null"))
        .select(
            "path",
            F.regexp_extract("line", hunk, 1).cast("int").alias("start"),
            F.when(count == "", 1).otherwise(count.try_cast("int")).alias("n"),
        )
        .where("n > 0")
        .select("path", "start", (F.col("start") + F.col("n") - 1).alias("end"))
    )


def content_rules(preset: str) -> list[dict]:
    keys = ("name", "pattern", "forbidden", "severity", "message")
    return [_with_path(dict(zip(keys, r, strict=True))) for r in fixed.CONTENT.get(preset, [])]


def _with_path(rule: dict) -> dict:
    return rule | {"path_regex": globs.path_regex(rule["pattern"])}


def taxonomy_rules(stack: str) -> list[dict]:
    keys = ("pattern", "purpose", "max_loc", "forbidden_imports", "message")
    return [dict(zip(keys, r, strict=True)) | {"forbidden_content": []} for r in fixed.TAXONOMY.get(stack, [])]


def folder_rules(stack: str) -> list[dict]:
    keys = ("pattern", "max_files", "required_children", "message")
    return [dict(zip(keys, r, strict=True)) for r in fixed.FOLDERS.get(stack, [])]


def load_rules(config: str | Path) -> dict[str, list[dict]]:
    """Rules of a TOML file by kind: ``taxonomy``, ``folders``, ``content``.

    Rows without a pattern are skipped; ``[taxonomy] enabled = false`` turns
    file rules off, ``[taxonomy] stack`` brings a stack's defaults where the
    file has none of its own; a missing or broken file gives no rules.
    """
    try:
        table = tomllib.loads(Path(config).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError):
        return {"taxonomy": [], "folders": [], "content": []}
    about = table.get("taxonomy", {})
    stack = about.get("stack", "")
    own = {"max_loc": None, "purpose": "", "forbidden_imports": [], "forbidden_content": [], "message": ""}
    taxonomy = [own | r for r in table.get("rules", []) if r.get("pattern")]
    folders = [
        {"max_files": None, "required_children": [], "message": ""} | r
        for r in table.get("folder_rules", [])
        if r.get("pattern")
    ]
    content = [
        _with_path(
            {
                "name": r.get("name", ""),
                "pattern": r["pattern"],
                "forbidden": r.get("forbidden_content", []),
                "severity": r.get("severity", "error"),
                "message": r.get("message", ""),
                "is_regex": r.get("is_regex", False),
            }
        )
        for r in table.get("repo_rules", [])
        if r.get("pattern")
    ]
    for preset in table.get("repo_rules_presets", []):
        content += content_rules(preset)
    return {
        "taxonomy": [] if about.get("enabled") is False else taxonomy or taxonomy_rules(stack),
        "folders": folders or folder_rules(stack),
        "content": content,
    }

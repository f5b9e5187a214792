"""The analyzers: each turns the views into a table of issues and a one-row summary."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_rules as fixed
from ..functions import globs, text
from ..operators import relational as rel
from ..sources import tree
from ..storage import keep
from .testtypes import classified
from .views import Views


@dataclass(frozen=True)
class Result:
    issues: DataFrame
    summary: DataFrame


@runtime_checkable
class Analyzer(Protocol):
    name: str
    description: str

    def analyze(self, views: Views) -> Result: ...


def load_analyzer(dotted: str) -> Analyzer:
    """An analyzer class by its dotted name, made without arguments."""
    module, _, name = dotted.rpartition(".")
    found = getattr(importlib.import_module(module), name)()
    if not isinstance(found, Analyzer):
        raise TypeError(f"{dotted} is not an analyzer")
    return found


def _said(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).alias("summary")


def _empty(value: Column, otherwise) -> Column:
    return F.coalesce(value, F.lit(otherwise))


# -- coverage ---------------------------------------------------------------


def _by_type() -> list[Column]:
    return [F.count_if(F.col("type") == t).alias(t) for t in fixed.TEST_TYPES] + [F.count(F.lit(1)).alias("total_tests")]


def coverage_table(views: Views) -> DataFrame:
    """Symbols with the number of test files of each type.

    A test covers a symbol if it refers to the symbol's name, or if its own
    file name lies in that of the symbol's file and it refers to that.  Tests
    are counted for each name and for each file stem before symbols come in,
    so a name that many symbols and tests share makes no pairs; tests that
    count both ways are taken off once.
    """
    types = classified(views.tests).select("path", F.coalesce("type", F.lit("unknown")).alias("type"))
    refs = views.references.join(types, "path").select("path", F.col("name").alias("ref"), "type")
    direct = refs.groupBy(F.col("ref").alias("name")).agg(*_by_type())
    symbols = views.symbols.withColumn("stem", text.stem(F.col("path")))
    subject = F.regexp_replace(F.regexp_replace(text.stem(F.col("path")), "^test_", ""), "_test$", "")
    named = refs.select(F.col("path").alias("test_path"), F.lower("ref").alias("ref"), "type", subject.alias("subject")).distinct()
    fuzzy = (
        symbols.select("stem")
        .distinct()
        .join(named, (F.lower("stem") == F.col("ref")) & (F.col("subject") != "") & F.contains("stem", F.col("subject")))
        .select("stem", "test_path", "type")
    )
    both = (
        fuzzy.join(symbols.select("stem", "name").distinct(), "stem")
        .join(refs.select(F.col("path").alias("test_path"), F.col("ref").alias("name")), ["test_path", "name"], "left_semi")
        .groupBy("stem", "name")
        .agg(*_by_type())
    )
    columns = [*fixed.TEST_TYPES, "total_tests"]
    tagged = lambda table, tag: table.withColumnsRenamed({c: f"{tag}_{c}" for c in columns})
    counted = (
        symbols.join(tagged(direct, "direct"), "name", "left")
        .join(tagged(fuzzy.groupBy("stem").agg(*_by_type()), "fuzzy"), "stem", "left")
        .join(tagged(both, "both"), ["stem", "name"], "left")
    )
    n = lambda c: _empty(F.col(f"direct_{c}"), 0) + _empty(F.col(f"fuzzy_{c}"), 0) - _empty(F.col(f"both_{c}"), 0)
    return counted.select(*views.symbols.columns, *[n(c).alias(c) for c in columns])


def unit_only(views: Views) -> DataFrame:
    return coverage_table(views).where("unit > 0 and integration = 0 and e2e = 0")


class Coverage:
    name, description = "coverage", "Symbols that no test refers to"

    def analyze(self, views: Views) -> Result:
        table = coverage_table(views)
        issues = table.where("total_tests = 0").select(
            F.col("name").alias("symbol"), F.col("path").alias("file"), F.col("line_start").alias("line"), F.lit("no tests").alias("reason")
        )
        total, covered = F.count(F.lit(1)), F.count_if(F.col("total_tests") > 0)
        summary = table.agg(
            _said(text.percentage(covered, total, 100.0), "% coverage — ", total - covered, " uncovered symbols")
        )
        return Result(issues, summary)


# -- observability ----------------------------------------------------------


def _observed(call: Column, lang: Column, extra: dict[str, list[str]]) -> Column:
    """A name of the language's family: equal, or followed by a dot or underscore."""
    checks = F.lit(False)
    for language in sorted({*fixed.OBSERVED, *extra}):
        prefixes = dict.fromkeys([*fixed.OBSERVED.get(language, []), *extra.get(language, [])])
        fits = F.exists(
            F.array(*[F.lit(p) for p in prefixes]),
            lambda p: (call == p) | F.startswith(call, F.concat(p, F.lit("."))) | F.startswith(call, F.concat(p, F.lit("_"))),
        )
        checks = checks | ((lang == language) & fits)
    return checks & ~call.isin(*fixed.NOT_OBSERVED)


def instrumented(views: Views, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Public functions and methods of source files with a flag ``lit``."""
    callables = views.symbols.where("kind in ('function', 'method') and is_public")
    lit = (
        views.calls.join(callables.select("path", "symbol_ord", "lang"), ["path", "symbol_ord"])
        .where(_observed(F.col("call_name"), F.col("lang"), extra or {}))
        .select("path", "symbol_ord")
        .distinct()
        .withColumn("lit", F.lit(True))
    )
    return callables.join(lit, ["path", "symbol_ord"], "left").withColumn("lit", F.coalesce("lit", F.lit(False)))


def dark_modules(views: Views) -> DataFrame:
    """Files whose public callables are all dark."""
    return instrumented(views).groupBy("path").agg(F.bool_or("lit").alias("lit")).where("not lit").select("path")


@dataclass(frozen=True)
class Observability:
    extra: dict[str, list[str]] = field(default_factory=dict)
    name = "observability"
    description = "Public functions without logging, tracing or error capture"

    def analyze(self, views: Views) -> Result:
        table = instrumented(views, self.extra)
        issues = table.where("not lit").select(
            F.col("name").alias("symbol"), F.col("path").alias("file"), F.col("line_start").alias("line"), F.lit("completely dark").alias("reason")
        )
        by_file = table.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if("lit").alias("n_lit"))
        total, lit = _empty(F.sum("n"), 0), _empty(F.sum("n_lit"), 0)
        summary = by_file.agg(
            _said(
                F.round(100 - text.percentage(total - lit, total, 0.0), 1), "% instrumented — ", total - lit, " dark functions, ",
                F.count_if(F.col("n_lit") == 0), " dark modules",
            )
        )
        return Result(issues, summary)


# -- size and concerns ------------------------------------------------------


def god_files(views: Views) -> DataFrame:
    counts = views.symbols.groupBy("path").agg(
        F.count_if(F.col("kind").isin("function", "method")).alias("n_functions"),
        F.count_if(F.col("kind") == "class").alias("n_classes"),
    )
    n = lambda c: _empty(F.col(c), 0)
    why = text.reasons(
        (F.col("loc") >= fixed.MAX_LOC, F.concat(F.col("loc").cast("string"), F.lit(f" LOC (threshold: {fixed.MAX_LOC})"))),
        (
            n("n_functions") >= fixed.MAX_CALLABLES,
            F.concat(n("n_functions").cast("string"), F.lit(f" functions/methods (threshold: {fixed.MAX_CALLABLES})")),
        ),
        (
            n("n_classes") >= fixed.MAX_CLASSES,
            F.concat(n("n_classes").cast("string"), F.lit(f" classes (threshold: {fixed.MAX_CLASSES})")),
        ),
    )
    return (
        views.sources.select("path", "loc")
        .join(counts, "path", "left")
        .select(F.lit("god_file").alias("type"), F.col("path").alias("file"), why.alias("reasons"))
        .where(F.size("reasons") > 0)
    )


def god_classes(views: Views) -> DataFrame:
    """Classes of many methods; one without a definition of its own starts at its first method."""
    methods = (
        views.symbols.where("kind = 'method' and parent_class is not null")
        .groupBy("path", F.col("parent_class").alias("symbol"))
        .agg(F.count(F.lit(1)).alias("method_count"), F.min_by("line_start", "symbol_ord").alias("first_line"))
        .where(F.col("method_count") >= fixed.MAX_METHODS)
    )
    classes = (
        views.symbols.where("kind = 'class'")
        .groupBy("path", F.col("name").alias("symbol"))
        .agg(F.max_by("line_start", "symbol_ord").alias("class_line"))
    )
    return methods.join(classes, ["path", "symbol"], "left").select(
        F.lit("god_class").alias("type"),
        "symbol",
        F.col("path").alias("file"),
        F.coalesce("class_line", "first_line").alias("line"),
        "method_count",
        F.array(F.concat(F.col("method_count").cast("string"), F.lit(f" methods (threshold: {fixed.MAX_METHODS})"))).alias("reasons"),
    )


def _layer(name: Column) -> Column:
    return F.coalesce(*[F.when(F.endswith(name, F.lit(s)), F.lit(layer)) for s, layer in fixed.ARCHETYPES.items()])


def mixed_concerns(views: Views) -> DataFrame:
    """Dart files whose classes belong to several layers, else UI files that import data packages."""
    layered = (
        views.symbols.where("kind = 'class' and lang = 'dart'")
        .withColumn("layer", _layer(F.col("name")))
        .where("layer is not null")
        .groupBy("path")
        .agg(
            F.array_sort(F.collect_set("layer")).alias("layers"),
            F.array_sort(F.collect_set(F.struct("name", "layer"))).alias("named"),
        )
    )
    listed = F.array_join(F.transform("named", lambda x: F.concat(x["name"], F.lit(" ("), x["layer"], F.lit(")"))), ", ")
    several = F.concat(F.lit("Multiple concern layers co-located ("), F.array_join("layers", ", "), F.lit("): "), listed)
    data = F.filter(
        F.array_sort(F.array(*[F.lit(p) for p in fixed.DATA_IMPORTS])),
        lambda p: F.contains(F.lower("source"), F.concat(F.lit("package:"), p, F.lit("/"))),
    )
    imports = F.concat(F.lit("UI class imports data-layer packages: "), F.array_join(data, ", "))
    reason = F.when(F.size("layers") >= 2, several).when(
        F.array_contains("layers", "ui") & (F.size(data) > 0), imports
    )
    return (
        views.sources.select("path", "source")
        .join(layered, "path")
        .select(F.lit("soc_violation").alias("type"), F.col("path").alias("file"), reason.alias("reason"))
        .where("reason is not null")
    )


class Solid:
    name, description = "solid", "Large files, large classes and mixed concerns"

    def analyze(self, views: Views) -> Result:
        issues = rel.union_issues(god_files(views), god_classes(views), mixed_concerns(views))
        n = {k: F.count_if(F.col("type") == k) for k in ("god_file", "god_class", "soc_violation")}
        summary = issues.agg(
            _said(
                F.count(F.lit(1)), " issues — ", n["god_file"], " god files, ", n["god_class"], " god classes, ",
                n["soc_violation"], " SoC violations",
            )
        )
        return Result(issues, summary)


# -- dead code --------------------------------------------------------------


@dataclass(frozen=True)
class DeadCode:
    min_confidence: str = "medium"
    entry_points: tuple[str, ...] = ()
    name = "dead_code"
    description = "Symbols whose name occurs in no other file"

    RANKS = ("low", "medium", "high")

    def table(self, views: Views) -> DataFrame:
        """Dead symbols with confidence and caveat.

        A name is dead in a file if no other file has it as a token: tokens
        that occur in two files are alive, and those of one are alive
        elsewhere only.
        """
        spread = views.tokens().groupBy("token").agg(F.min("path").alias("low"), F.max("path").alias("high"))
        alive = (F.col("token").isNotNull()) & ((F.col("low") != F.col("path")) | (F.col("high") != F.col("path")))
        name = F.col("name")
        considered = views.symbols.where(
            ~(F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")))
            & ~name.isin(*dict.fromkeys([*fixed.ENTRY_POINTS, *self.entry_points]))
        )
        private = F.startswith(name, F.lit("_"))
        is_method, hidden = F.col("kind") == "method", ~F.col("is_public")
        level = F.when(is_method, 0).when(private | hidden, 1).otherwise(2)
        caveat = (
            F.when(is_method, "Methods may be called via polymorphism or dynamic dispatch")
            .when(private, "Private symbol — could be accessed via getattr() or reflection")
            .when(hidden, "Non-public symbol")
        )
        return (
            considered.join(spread, name == F.col("token"), "left")
            .where(~alive)
            .withColumn("rank", level)
            .where(F.col("rank") >= self.RANKS.index(self.min_confidence))
            .select(
                name.alias("symbol"),
                "kind",
                F.col("path").alias("file"),
                F.col("line_start").alias("line"),
                F.element_at(F.array(*[F.lit(r) for r in self.RANKS]), F.col("rank") + 1).alias("confidence"),
                caveat.alias("caveat"),
            )
        )

    def analyze(self, views: Views) -> Result:
        issues = self.table(views)
        totals = views.symbols.agg(F.count(F.lit(1)).alias("n_symbols"))
        files = views.sources.agg(F.count(F.lit(1)).alias("n_files"))
        dead = issues.agg(F.count(F.lit(1)).alias("n_dead"), F.count_if(F.col("confidence") == "high").alias("n_high"))
        one = dead.join(totals, how="full").join(files, how="full")  # one row each
        some = _said(
            F.col("n_dead"), " dead symbols (", F.col("n_high"), " high-confidence) of ", F.col("n_symbols"), " total (", F.col("n_files"), " files)"
        )
        none = _said("No dead code found (", F.col("n_symbols"), " symbols, ", F.col("n_files"), " files)")
        return Result(issues, one.select(F.when(F.col("n_dead") > 0, some).otherwise(none).alias("summary")))


# -- rules ------------------------------------------------------------------


def file_imports(source: Column, path: Column) -> Column:
    """Imported modules by the file's suffix, as patterns see them."""
    kind = text.suffix(path)
    every = lambda pattern: F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
    return (
        F.when(kind == ".dart", every(r"import\s+['\"]([^'\"]+)['\"]"))
        .when(kind == ".py", every(r"(?m)^(?:import|from)\s+([\w.]+)"))
        .when(kind == ".rs", every(r"(?m)^use\s+([\w:]+)"))
        .when(kind.isin(".ts", ".tsx", ".js", ".jsx"), every(r"from\s+['\"]([^'\"]+)['\"]"))
        .otherwise(F.array().cast("array<string>"))
    )


def _taxonomy_reasons(rule: dict) -> Column:
    checks = []
    if rule["max_loc"]:
        checks.append(
            (
                F.col("loc") > rule["max_loc"],
                F.concat(F.lit(f"exceeds {rule['max_loc']} LOC ("), F.col("loc").cast("string"), F.lit(" lines)")),
            )
        )
    for name in rule["forbidden_imports"]:
        held = F.exists("found_imports", lambda i: F.contains(F.lower(i), F.lit(name.lower())))
        checks.append((held, F.lit(f"forbidden import: {name}")))
    for part in rule["forbidden_content"]:
        held = F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit(part.lower()))
        checks.append((held, F.lit(f"forbidden content: {part}")))
    return text.reasons(*checks) if checks else F.array().cast("array<string>")


@dataclass(frozen=True)
class Taxonomy:
    rules: tuple[dict, ...] = ()
    name = "taxonomy"
    description = "File-name rules: length, imports and content"

    def matches(self, files: DataFrame) -> DataFrame:
        """``(file, rule_pattern, purpose, reasons, message)`` of every file and rule whose pattern fits."""
        base = text.basename(F.col("path"))
        found = [
            F.when(
                base.rlike(globs.filename_regex(r["pattern"])),
                F.struct(
                    F.lit(r["pattern"]).alias("rule_pattern"),
                    F.lit(r["purpose"]).alias("purpose"),
                    _taxonomy_reasons(r).alias("reasons"),
                    F.lit(r["message"]).alias("message"),
                ),
            )
            for r in self.rules
        ]
        schema = "array<struct<rule_pattern:string,purpose:string,reasons:array<string>,message:string>>"
        fits = F.array_compact(F.array(*found)) if found else F.array().cast(schema)
        return (
            files.select("path", "loc", "source", file_imports(F.col("source"), F.col("path")).alias("found_imports"))
            .select(F.col("path").alias("file"), F.explode(fits).alias("m"))
            .select("file", "m.*")
        )

    def check_file(self, proposed: DataFrame) -> DataFrame:
        """Verdicts of proposed files ``(path, source)``."""
        sized = proposed.withColumn("loc", text.loc(F.col("source")))
        return self.matches(sized).where(F.size("reasons") > 0)

    def analyze(self, views: Views) -> Result:
        matched = self.matches(views.sources)
        summary = matched.agg(
            _said(
                F.count_if(F.size("reasons") > 0), " taxonomy violations across ", F.count_distinct("file"), " files (",
                F.lit(len(self.rules)), " rules active)",
            )
        )
        return Result(matched.where(F.size("reasons") > 0), summary)


@dataclass(frozen=True)
class FolderStructure:
    rules: tuple[dict, ...] = ()
    name = "folder_structure"
    description = "Folder rules: direct files and required subfolders"

    def matches(self, folders: DataFrame) -> DataFrame:
        found = []
        for r in self.rules:
            n = F.col("n_files")
            checks = []
            if r["max_files"] == 0:
                words = (F.lit("flat file dump — "), n.cast("string"), F.lit(" loose source files (should be organized into subdirectories)"))
                checks.append((n > 0, F.concat(*words)))
            elif r["max_files"] is not None:
                checks.append((n > r["max_files"], F.concat(n.cast("string"), F.lit(f" files exceeds limit of {r['max_files']}"))))
            for child in r["required_children"]:
                checks.append((~F.array_contains("children", child), F.lit(f"missing required subdirectory: {child}/")))
            why = text.reasons(*checks) if checks else F.array().cast("array<string>")
            found.append(
                F.when(
                    F.col("path").rlike(globs.segments_regex(r["pattern"])),
                    F.struct(F.lit(r["pattern"]).alias("rule_pattern"), why.alias("reasons"), F.lit(r["message"]).alias("message")),
                )
            )
        schema = "array<struct<rule_pattern:string,reasons:array<string>,message:string>>"
        fits = F.array_compact(F.array(*found)) if found else F.array().cast(schema)
        return folders.select(F.col("path").alias("folder"), F.explode(fits).alias("m")).select("folder", "m.*")

    def check_new_files(self, proposed: DataFrame, folders: DataFrame) -> DataFrame:
        """Folders that would break a file limit with one more file, for ``(path)`` rows of new files."""
        wanted = proposed.select(text.parent(F.col("path")).alias("path")).distinct()
        grown = wanted.join(folders, "path", "left").select(
            "path",
            (F.coalesce("n_files", F.lit(0)) + 1).alias("n_files"),
            F.coalesce("children", F.array().cast("array<string>")).alias("children"),
        )
        limits = FolderStructure(tuple(r | {"required_children": []} for r in self.rules))
        return limits.matches(grown).where(F.size("reasons") > 0)

    def analyze(self, views: Views) -> Result:
        matched = self.matches(views.folders)
        summary = matched.agg(
            _said(
                F.count_if(F.size("reasons") > 0), " folder structure violations (", F.count_distinct("folder"),
                " folders checked, ", F.lit(len(self.rules)), " rules)",
            )
        )
        return Result(matched.where(F.size("reasons") > 0), summary)


@dataclass(frozen=True)
class RepoRules:
    rules: tuple[dict, ...] = ()
    name = "repo_rules"
    description = "Content rules by path"

    def matches(self, files: DataFrame) -> DataFrame:
        found = rel.scan_rules(
            files.select("path", "source"), list(self.rules), ["path"], text.source_lines(F.col("source")), F.col("path")
        )
        return found.select(F.col("path").alias("file"), "line", "rule", "severity", "matched", "message")

    def analyze(self, views: Views) -> Result:
        issues = self.matches(views.sources)
        fits = [F.col("path").rlike(r["path_regex"]) for r in self.rules]
        checked = views.sources.select(F.coalesce(F.greatest(*fits, F.lit(False)), F.lit(False)).alias("fit") if fits else F.lit(False).alias("fit"))
        n_files = checked.agg(F.count_if("fit").alias("n_files"))
        counts = issues.agg(
            F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") != "error").alias("w")
        )
        parts = text.reasons(
            (F.col("e") > 0, F.concat(F.col("e").cast("string"), F.lit(" errors"))),
            (F.col("w") > 0, F.concat(F.col("w").cast("string"), F.lit(" warnings"))),
        )
        head = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("clean")
        one = counts.join(n_files, how="full")  # one row each
        return Result(issues, one.select(_said(head, " (", F.col("n_files"), f" files, {len(self.rules)} rules)")))


# -- change impact ----------------------------------------------------------


@dataclass(frozen=True)
class BlastRadius:
    """Callers of changed symbols; ``hunks(path, start, end)`` of :func:`tree.parse_diff`.

    A file refers to a name if it imports or calls it; all its symbols then
    are callers of that name.  Callers of callers are followed for
    ``depth`` - 1 further levels, each name under the first one that reached it.
    """

    hunks: DataFrame
    depth: int = 2
    name = "blast_radius"
    description = "Callers of what a diff changes, and whether tests cover them"

    def changed(self, views: Views) -> DataFrame:
        ranges = views.symbols.withColumnsRenamed({"line_start": "start", "line_end": "end"})
        return rel.overlap_semi(ranges, self.hunks, "path", "start", "end").select(
            "path", "symbol_ord", "name", F.col("start").alias("line")
        )

    def edges(self, views: Views) -> DataFrame:
        """``(callee, caller, caller_path, caller_line)``."""
        owned = views.symbols.select("path", "name", "symbol_ord", "line_start")
        refs = views.references.join(views.sources.select("path"), "path", "left_semi")
        used = rel.other_owner_semi(refs, owned, "name", "path").select("path", F.col("name").alias("callee"))
        return used.join(owned, "path").select(
            "callee", F.col("name").alias("caller"), F.col("path").alias("caller_path"), F.col("symbol_ord").alias("caller_ord"), F.col("line_start").alias("caller_line")
        )

    def callers(self, views: Views) -> DataFrame:
        """``(changed, changed_path, relation, caller, caller_path, caller_line, is_covered)``."""
        edges = keep(self.edges(views), "edges")
        changed = keep(
            self.changed(views).select(F.col("name").alias("changed"), F.col("path").alias("changed_path")).distinct(), "changed"
        )
        direct = changed.join(edges, F.col("changed") == F.col("callee")).withColumn("relation", F.lit("direct"))
        found = level = keep(direct, "callers")
        seen = changed.select(F.col("changed").alias("root"), F.col("changed").alias("seen")).distinct()
        for _ in range(self.depth - 1):
            seen = seen.unionByName(level.select(F.col("changed").alias("root"), F.col("caller").alias("seen")).distinct())
            step = level.select("changed", "changed_path", F.col("caller").alias("via")).distinct()
            reached = step.join(edges, F.col("via") == F.col("callee")).select("changed", "changed_path", *edges.columns)
            fresh = reached.join(seen, (F.col("changed") == F.col("root")) & (F.col("caller") == F.col("seen")), "left_anti")
            # the first that reaches a name, as one aggregate: a name that everybody calls is combined where it is read
            place = F.struct("caller_path", "caller_ord", "caller_line", "changed_path", "callee")
            level = keep(
                fresh.groupBy("changed", "caller")
                .agg(F.min(place).alias("first"))
                .select(
                    "changed",
                    "first.changed_path",
                    "first.callee",
                    "caller",
                    "first.caller_path",
                    "first.caller_ord",
                    "first.caller_line",
                    F.lit("transitive").alias("relation"),
                ),
                "callers",
            )
            if not level.head(1):
                break
            found = found.unionByName(level.select(found.columns))
        covered = (
            coverage_table(views).where("total_tests > 0").select(F.col("name").alias("covered_name")).distinct()
        )
        return found.join(covered, F.col("caller") == F.col("covered_name"), "left").select(
            "changed",
            "changed_path",
            "relation",
            "caller",
            "caller_path",
            "caller_line",
            F.col("covered_name").isNotNull().alias("is_covered"),
        )

    def analyze(self, views: Views) -> Result:
        callers = self.callers(views)
        issues = callers.where("not is_covered").select(
            F.lit("uncovered_caller").alias("type"),
            F.col("changed").alias("changed_symbol"),
            F.col("changed_path").alias("changed_file"),
            "caller",
            F.col("caller_path").alias("caller_file"),
            "caller_line",
            F.concat("caller", F.lit(" calls "), "changed", F.lit(" but has no tests")).alias("reason"),
        )
        totals = callers.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_covered")).alias("bare"))
        changed = self.changed(views).agg(F.count(F.lit(1)).alias("n_changed"))
        one = totals.join(changed, how="full")  # one row each
        return Result(
            issues,
            one.select(
                _said(F.col("n_changed"), " symbols changed, ", F.col("n"), " callers affected, ", F.col("bare"), " with no test coverage")
            ),
        )


# -- metrics ----------------------------------------------------------------


class Metrics:
    name, description = "metrics", "Lines, symbols and tests by language"

    def by_file(self, views: Views) -> DataFrame:
        """``(path, lang, is_test, loc, functions, classes, import_count)`` of every file."""
        counts = views.all_symbols.groupBy("path").agg(
            F.count_if(F.col("kind").isin("function", "method")).alias("functions"),
            F.count_if(F.col("kind") == "class").alias("classes"),
        )
        imports = F.size(file_imports(F.col("source"), F.col("path"))).alias("import_count")
        return (
            views.files.select("path", "lang", "is_test", "loc", imports)
            .join(counts, "path", "left")
            .select("path", "lang", "is_test", "loc", _empty(F.col("functions"), 0).alias("functions"), _empty(F.col("classes"), 0).alias("classes"), "import_count")
        )

    def totals(self, views: Views) -> DataFrame:
        """One row: files, lines in all, of sources, of tests, and the ratio of tests to sources (0 without sources)."""
        test, source = F.sum(F.when(F.col("is_test"), F.col("loc"))), F.sum(F.when(~F.col("is_test"), F.col("loc")))
        return views.files.agg(
            F.count(F.lit(1)).alias("n_files"),
            _empty(F.sum("loc"), 0).alias("total_loc"),
            _empty(source, 0).alias("source_loc"),
            _empty(test, 0).alias("test_loc"),
            _empty(F.round(F.try_divide(_empty(test, 0), source), 3), 0.0).alias("test_to_source_ratio"),
        )

    def analyze(self, views: Views) -> Result:
        table = self.by_file(views).groupBy("lang").agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if("is_test").alias("test_files"),
            F.sum("loc").alias("loc"),
            F.sum("functions").alias("functions"),
            F.sum("classes").alias("classes"),
        )
        share = F.round(F.col("files") * 100.0 / F.sum("files").over(Window.partitionBy(F.lit(0))), 1)  # a row a language
        summary = self.totals(views).select(
            _said(F.col("n_files"), " files, ", F.col("total_loc"), " lines, ", F.col("test_to_source_ratio"), " test lines a source line")
        )
        return Result(table.withColumn("share", share), summary)


def default_analyzers(stack: str | None = None, preset: str = "general") -> list[Analyzer]:
    return [
        Coverage(),
        Observability(),
        Solid(),
        DeadCode(),
        Taxonomy(tuple(tree.taxonomy_rules(stack or ""))),
        FolderStructure(tuple(tree.folder_rules(stack or ""))),
        RepoRules(tuple(tree.content_rules(preset))),
        Metrics(),
    ]


def run(views: Views, analyzers: list[Analyzer], only: list[str] | None = None) -> dict[str, Result]:
    """Lazy results by name; ``only`` selects analyzers."""
    return {a.name: a.analyze(views) for a in analyzers if not only or a.name in only}


def issue_totals(results: dict[str, Result]) -> DataFrame:
    """``(analyzer, n_issues)`` of every result, and their sum under ``all``."""
    counted = [r.issues.agg(F.count(F.lit(1)).alias("n_issues")).select(F.lit(n).alias("analyzer"), "n_issues") for n, r in results.items()]
    each = rel.union_issues(*counted)
    return each.unionByName(each.agg(F.sum("n_issues").alias("n_issues")).select(F.lit("all").alias("analyzer"), "n_issues"))

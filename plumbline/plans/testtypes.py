"""Test types: the first signal that fits, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_rules as fixed
from ..functions import text


def _first(pairs: Column) -> Column:
    return F.try_element_at(F.filter(pairs, lambda x: x["primary"].isNotNull()), F.lit(1))


def _typed(value: Column, signal: Column) -> Column:
    return F.struct(value.alias("primary"), F.array(signal).alias("signals"))


def _branches(subject: Column, table: dict[str, str], fits) -> Column:
    return F.coalesce(*[F.when(fits(subject, key), F.lit(kind)) for key, kind in table.items()])


def classify(path: Column, imports: Column, markers: Column) -> Column:
    """``struct(primary, signals)``: marker, else path component, else import root, else unit.

    Components are tried in their order, for each the fragments in theirs; a
    component fits if it contains the fragment.
    """
    contains = lambda s, key: F.contains(s, F.lit(key))
    equals = lambda s, key: s == key
    cleaned = F.transform(F.coalesce(markers, F.array().cast("array<string>")), lambda m: F.trim(m))
    by_marker = F.transform(
        cleaned, lambda m: _typed(_branches(m, fixed.TEST_MARKERS, contains), F.concat(F.lit("marker:"), m))
    )
    lowered = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    components = F.filter(F.concat(F.split(lowered, "/"), F.array(text.stem(lowered))), lambda c: c != "")
    by_path = F.transform(
        components, lambda c: _typed(_branches(c, fixed.TEST_PATHS, contains), F.concat(F.lit("path:"), c))
    )
    roots = F.transform(
        F.coalesce(imports, F.array().cast("array<string>")), lambda i: F.lower(F.substring_index(i, ".", 1))
    )
    by_import = F.transform(
        roots, lambda r: _typed(_branches(r, fixed.TEST_IMPORTS, equals), F.concat(F.lit("import:"), r))
    )
    return F.coalesce(
        _first(by_marker), _first(by_path), _first(by_import), _typed(F.lit("unit"), F.lit("fallback:unit"))
    )


def classified(tests: DataFrame) -> DataFrame:
    """``(path, type)`` of test files."""
    none = F.array().cast("array<string>")
    return tests.select("path", classify(F.col("path"), F.col("imports"), none)["primary"].alias("type"))

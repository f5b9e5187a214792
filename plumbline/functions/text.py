"""Scalar expressions over texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loc(source: Column) -> Column:
    """Newlines plus one; an empty text has one line."""
    return F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit(""))) + 1


def source_lines(source: Column) -> Column:
    """Lines as an editor shows them: no empty last line after a final terminator."""
    parts = F.split(source, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]")
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(source == "", F.array().cast("array<string>")).otherwise(trimmed)


def identifiers(text: Column) -> Column:
    """Distinct identifier tokens, in the order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    """Directory of a path, empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def reasons(*checks: tuple[Column, Column]) -> Column:
    """Texts of the checks that hold, in their order."""
    return F.array_compact(F.array(*[F.when(condition, text) for condition, text in checks]))


def first_match(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """Value of the first branch whose condition holds."""
    return F.coalesce(*[F.when(condition, value) for condition, value in branches], otherwise)


def percentage(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, 1), F.lit(empty))


def pascal(name: Column) -> Column:
    words = F.filter(F.split(name, "[^a-zA-Z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20)))), "")


def snake(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """``{{key}}`` replaced by each value, in turn."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template

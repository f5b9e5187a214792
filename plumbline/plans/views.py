"""The tables that analyzers read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import parse, tree
from ..storage import keep


@dataclass(frozen=True)
class Views:
    """Files and what one parse of them gives; the parse is written once, the rest is lazy."""

    files: DataFrame
    parsed: DataFrame
    folders: DataFrame

    @classmethod
    def of(cls, files: DataFrame, root: str | None = None) -> Views:
        parsed = keep(parse.parse_files(files), "parsed")
        return cls(files, parsed, tree.folders_table(files, root))

    @classmethod
    def scan(cls, spark: SparkSession, root: str) -> Views:
        return cls.of(tree.scan_tree(spark, root), root)

    @property
    def sources(self) -> DataFrame:
        return self.files.where("not is_test")

    @property
    def tests(self) -> DataFrame:
        return self.files.where("is_test")

    @property
    def all_symbols(self) -> DataFrame:
        return parse.symbols(self.parsed)

    @property
    def symbols(self) -> DataFrame:
        """Symbols of source files."""
        return self.all_symbols.join(self.sources.select("path"), "path", "left_semi")

    @property
    def references(self) -> DataFrame:
        return parse.references(self.parsed)

    @property
    def calls(self) -> DataFrame:
        return parse.calls(self.parsed)

    def tokens(self) -> DataFrame:
        """Distinct identifiers of every file, comments and strings included."""
        return self.files.select("path", F.explode(text.identifiers(F.col("source"))).alias("token"))

    def symbol_map(self, lang: str | None = None) -> DataFrame:
        found = self.symbols if lang is None else self.symbols.where(F.col("lang") == lang)
        return found.select("name", "kind", "path", "line_start", "line_end", "lang", "parent_class", "is_public", "is_async")

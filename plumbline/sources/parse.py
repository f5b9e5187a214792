"""Symbols, references and calls of source texts, by one Arrow-batched pass.

Python is parsed by the standard library's syntax trees (lines alone where a
text doesn't parse); Rust and Dart are scanned by braces; other languages
give nothing and never fail.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files whose texts a worker holds as Python strings.
FILES_AT_ONCE = 64
#: One row for each symbol, reference and call; ``tag`` says which.
SCHEMA = (
    "path string, tag string, symbol_ord int, name string, kind string, line_start int, line_end int, lang string, "
    "decorators array<string>, parent_class string, is_async boolean, is_public boolean"
)


def _symbol(ord_, name, kind, start, end, lang, decorators=(), parent=None, is_async=False, public=True):
    return ("symbol", ord_, name, kind, start, end, lang, list(decorators), parent, is_async, public)


def _ref(name):
    return ("ref", None, name, None, None, None, None, None, None, None, None)


def _call(ord_, name):
    return ("call", ord_, name, None, None, None, None, None, None, None, None)


class _Python(ast.NodeVisitor):
    """Definitions outside function bodies; calls of each body."""

    def __init__(self):
        self.rows, self.parents, self.count = [], [], 0

    def _decorators(self, node):
        return [ast.unparse(d).split("(")[0] for d in node.decorator_list]

    def visit_ClassDef(self, node):
        start = min([node.lineno, *[d.lineno for d in node.decorator_list]])
        self._add(node, "class", start, False)
        self.parents.append(node.name)
        for child in node.body:
            self.visit(child)
        self.parents.pop()

    def visit_FunctionDef(self, node, is_async=False):
        ord_ = self._add(node, "method" if self.parents else "function", node.lineno, is_async)
        for statement in node.body:
            for inner in ast.walk(statement):
                if isinstance(inner, ast.Call) and isinstance(inner.func, (ast.Name, ast.Attribute)):
                    self.rows.append(_call(ord_, ast.unparse(inner.func)))

    def visit_AsyncFunctionDef(self, node):
        self.visit_FunctionDef(node, True)

    def visit_Lambda(self, node):
        pass

    def _add(self, node, kind, start, is_async):
        ord_, self.count = self.count, self.count + 1
        parent = self.parents[-1] if self.parents else None
        self.rows.append(
            _symbol(
                ord_, node.name, kind, start, node.end_lineno, "python", self._decorators(node), parent, is_async,
                not node.name.startswith("_"),
            )
        )
        return ord_


def _python(source: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_lines(source)
    visitor = _Python()
    visitor.visit(tree)
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names.update(a.asname or a.name.split(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            names.update(a.asname or a.name for a in node.names if a.name != "*")
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                names.add(node.func.id)
            elif isinstance(node.func, ast.Attribute):
                names.add(node.func.attr)
    return visitor.rows + [_ref(n) for n in sorted(names)]


_PY_DEF = re.compile(r"^([ \t]*)(async\s+)?(def|class)\s+(\w+)", re.M)


def _python_by_lines(source: str) -> list[tuple]:
    """Definitions of a text that doesn't parse, by indentation."""
    rows, outer = [], []
    places = _Places(source)
    for ord_, m in enumerate(_PY_DEF.finditer(source)):
        depth, line = len(m[1].expandtabs()), places.line(m.start())
        while outer and outer[-1][0] >= depth:
            outer.pop()
        parent = outer[-1][1] if outer and outer[-1][2] == "class" else None
        kind = "class" if m[3] == "class" else "method" if parent else "function"
        rows.append(_symbol(ord_, m[4], kind, line, line, "python", (), parent, bool(m[2]), not m[4].startswith("_")))
        outer.append((depth, m[4], m[3]))
    return rows


_HIDDEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|r#\".*?\"#|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S
)
_RUST_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|r#\".*?\"#|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)


def _blank(pattern: re.Pattern, source: str) -> str:
    """Comments and strings as blanks of equal length, lines kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


class _Places:
    """Lines and braces of a text, found once."""

    def __init__(self, text: str):
        self.size = len(text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.braces, self.depths, self.closing, open_ = [], [], {}, []
        for m in re.finditer(r"[{}]", text):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                self.closing[open_.pop()] = m.start()
            self.braces.append(m.start())
            self.depths.append((self.depths[-1] if self.depths else 0) + (1 if m[0] == "{" else -1))

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def depth(self, at: int) -> int:
        """Braces open before ``at``, less those closed."""
        k = bisect_left(self.braces, at)
        return self.depths[k - 1] if k else 0

    def close(self, at: int) -> int:
        """Place of the brace that closes the one at ``at``, or of the text's end."""
        return self.closing.get(at, self.size - 1)


_RUST = re.compile(
    r"^[ \t]*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:(?:const|unsafe|extern(?:\s+\S+)?|default)\s+)*(?:"
    r"(?P<async>async\s+)?(?:unsafe\s+)?fn\s+(?P<fn>\w+)|(?:struct|enum)\s+(?P<type>\w+)|impl\b(?P<impl>[^{;]*))",
    re.M,
)


def _rust(source: str) -> list[tuple]:
    text = _blank(_RUST_HIDDEN, source)
    places = _Places(text)
    line_of, count = places.line, 0
    rows, impls = [], []
    for m in _RUST.finditer(text):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        brace, semi = text.find("{", m.end()), text.find(";", m.end())
        has_body = brace >= 0 and not 0 <= semi < brace
        end = places.close(brace) if has_body else (semi if semi >= 0 else m.end() - 1)
        if m["impl"] is not None:
            about = re.sub(r"\bwhere\b.*", "", re.sub(r"^\s*<[^>]*>", "", m["impl"]), flags=re.S)
            impls.append((start, end, re.split(r"\bfor\b", about)[-1].strip()))
            continue
        while impls and impls[-1][1] < start:  # blocks that ended before hold nothing more
            impls.pop()
        inside = [i for i in impls[-1:] if i[0] < start]
        ord_, count = count, count + 1
        if m["type"]:
            rows.append(_symbol(ord_, m["type"], "class", line_of(start), line_of(end), "rust"))
            continue
        parent = inside[-1][2] if inside else None
        rows.append(
            _symbol(ord_, m["fn"], "method" if parent else "function", line_of(start), line_of(end), "rust", (), parent,
                    bool(m["async"]), bool(m["vis"]))
        )
        if has_body:
            for c in re.finditer(r"\b([A-Za-z_]\w*(?:(?:::|\.)\w+)*)\s*!?\s*\(", text[brace:end]):
                rows.append(_call(ord_, c[1].replace("::", ".")))
    return rows


_DART_CLASS = re.compile(r"^[ \t]*(?:(?:abstract|sealed|base|final|interface)\s+)*(?:class|mixin)\s+(\w+)[^{;]*\{", re.M)
_DART_FN = re.compile(
    r"^[ \t]*(?:(?:static|external|const|factory|late|override)\s+)*(?:[A-Za-z_][\w<>,? .]*?\s+)?(?:(?:get|set)\s+)?"
    r"(?P<name>[A-Za-z_]\w*)(?:\.\w+)?\s*(?:<[^>]*>)?\((?P<args>[^;{}]*?)\)\s*(?P<mode>async\*?|sync\*)?\s*(?=\{|=>|;)",
    re.M | re.S,
)
_DART_NOT = {"if", "for", "while", "switch", "catch", "return", "assert", "super", "this", "await", "throw", "else"}


def _dart(source: str) -> list[tuple]:
    text = _blank(_HIDDEN, source)
    places = _Places(text)
    line_of = places.line
    classes = [(m.start(), m.end() - 1, places.close(m.end() - 1), m[1]) for m in _DART_CLASS.finditer(text)]
    ahead, around = list(reversed(classes)), []
    found = [(a + len(text[a:b]) - len(text[a:b].lstrip()), "class", name, None, end, None) for a, b, end, name in classes]
    busy_until = -1
    for m in _DART_FN.finditer(text):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        while ahead and ahead[-1][1] < start:
            around.append(ahead.pop())
        around = owner = [c for c in around if c[2] > start]
        depth = places.depth(start)
        if start < busy_until or m["name"] in _DART_NOT or depth != len(owner):
            continue
        if re.match(r"\s*(return|await|throw|else|new)\b", text[m.start() : m.end()]):
            continue
        brace = text.find("{", m.end())
        body = (m.end(), m.end())
        if text[m.end() : m.end() + 1] == "{":
            body = (brace, places.close(brace))
        elif text[m.end() : m.end() + 2] == "=>":
            stop = text.find(";", m.end())
            body = (m.end(), stop if stop >= 0 else len(text))
        busy_until = body[1]
        found.append((start, "method" if owner else "function", m["name"], owner[-1][3] if owner else None, m.end() - 1, (body, m["mode"])))
    rows = []
    for ord_, (start, kind, name, parent, end, more) in enumerate(sorted(found, key=lambda f: f[0])):
        is_async = bool(more and more[1] and more[1].startswith("async"))
        rows.append(
            _symbol(ord_, name, kind, line_of(start), line_of(end), "dart", (), parent, is_async, not name.startswith("_"))
        )
        if more:
            for name_ in sorted(set(re.findall(r"[A-Za-z_]\w*", text[more[0][0] : more[0][1]]))):
                rows.append(_call(ord_, name_))
    return rows


_PARSERS = {"python": _python, "rust": _rust, "dart": _dart}


def parse_source(source: str | None, lang: str) -> list[tuple]:
    parser = _PARSERS.get(lang)
    return parser(source or "") if parser else []


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(),
             pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, FILES_AT_ONCE):
            few = batch.slice(at, FILES_AT_ONCE)
            rows = [
                (path, *row)
                for path, lang, source in zip(*(c.to_pylist() for c in few.columns), strict=True)
                for row in parse_source(source, lang)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def parse_files(files: DataFrame) -> DataFrame:
    """Tagged rows of ``files``; split them with :func:`symbols`, :func:`references` and :func:`calls`."""
    return files.select("path", "lang", "source").mapInArrow(_parse_batches, SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.where("tag = 'symbol'").drop("tag")


def references(parsed: DataFrame) -> DataFrame:
    return parsed.where("tag = 'ref'").select("path", "name").distinct()


def calls(parsed: DataFrame) -> DataFrame:
    return parsed.where("tag = 'call'").select("path", "symbol_ord", F.col("name").alias("call_name"))

"""Imports of source files: a table function per language, and their resolution to files.

A parser is a function from a text to rows; parse_imports() runs the registered one of each file's language. Regular ones are written as
line patterns and run in batches. Resolution is an equi-join: every import is expanded to its candidate paths in order, and the first
that exists wins."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.schemas import IMPORT_ROWS


class Import(NamedTuple):
    module: str
    name: str | None
    kind: str
    line: int
    is_external: bool
    raw: str


Parser = Callable[[str], Iterator[Import]]


def code_lines(text: str, line_comment: str, whole_line: bool = False) -> Iterator[tuple[int, str]]:
    """Numbered lines outside block comments. A line that ends one is dropped; a line comment is cut off, or with
    whole_line makes the line drop if it begins it."""
    inside = False
    for number, line in enumerate(text.split("\n"), 1):
        inside = inside or "/*" in line
        if "*/" in line:
            inside = False
        elif not inside:
            if whole_line and line.strip().startswith(line_comment):
                continue
            yield number, line if whole_line else line.split(line_comment, 1)[0]


def _joined(lines: Iterator[tuple[int, str]]) -> tuple[str, list[int]]:
    numbers, texts = zip(*lines) if (lines := list(lines)) else ((), ())
    return "\n".join(texts), list(numbers)


def _matches(pattern: str, text: str, numbers: list[int], flags: int = 0) -> Iterator[tuple[re.Match, int]]:
    for m in re.finditer(pattern, text, flags):
        yield m, numbers[text.count("\n", 0, m.start())]


def python_imports(text: str) -> Iterator[Import]:
    """One row an alias; relative ones are internal. A text that does not parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for alias in node.names:
                yield Import(alias.name, alias.asname, "import", node.lineno, True, f"import {alias.name}")
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for alias in node.names:
                yield Import(module, alias.name, "from", node.lineno, node.level == 0, f"from {module} import {alias.name}")


def javascript_imports(text: str) -> Iterator[Import]:
    code, numbers = _joined(code_lines(text, "//"))
    for m, line in _matches(r"""\bimport\s+(?:[\w*\s{},$]+?\s+from\s+)?['"]([^'"]+)['"]""", code, numbers):
        yield Import(m[1], None, "import", line, True, m[0])
    for m, line in _matches(r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""", code, numbers):
        yield Import(m[1], None, "require", line, True, m[0])


def java_imports(text: str) -> Iterator[Import]:
    for number, line in code_lines(text, "//"):
        if m := re.match(r"\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", line):
            yield Import(re.sub(r"[.*]+$", "", m[2]), None, "static" if m[1] else "import", number, True, line.strip())


def go_imports(text: str) -> Iterator[Import]:
    numbers = list(range(1, text.count("\n") + 2))
    for m, line in _matches(r'import\s+"([^"]+)"', text, numbers):
        yield Import(m[1], None, "import", line, True, m[0])
    for block in re.finditer(r"import\s*\(([^)]*)\)", text):
        for m in re.finditer(r'"([^"]+)"', block[1]):
            yield Import(m[1], None, "import", numbers[text.count("\n", 0, block.start(1) + m.start())], True, m[0])


def rust_imports(text: str) -> Iterator[Import]:
    for number, line in enumerate(text.split("\n"), 1):
        line = line.split("//", 1)[0].strip()
        if m := re.match(r"use\s+([\w:]+)", line):
            yield Import(m[1], None, "import", number, not m[1].startswith(("crate", "super", "self")), line)
        if m := re.match(r"mod\s+(\w+)", line):
            yield Import(m[1], None, "mod", number, False, line)


# Where a table's name stands in SQL, and words that are none.
SQL_TABLES = (
    r"(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+(\w+)", r"FROM\s+(\w+)", r"JOIN\s+(\w+)",
    r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)", r"ALTER\s+TABLE\s+(\w+)", r"DROP\s+TABLE\s+(\w+)",
)
SQL_WORDS = ("FROM", "INTO", "UPDATE", "DELETE", "SELECT", "INSERT", "JOIN", "TABLE", "ALTER", "DROP")


def sql_imports(text: str) -> Iterator[Import]:
    code, numbers = _joined(code_lines(text, "--", whole_line=True))
    for m, line in _matches(r"""\\i\s+['"]?([^'"\s]+)['"]?""", code, numbers):
        yield Import(m[1], None, "sql_file", line, False, m[0])
    for pattern in SQL_TABLES:
        for m, line in _matches(pattern, code, numbers, re.IGNORECASE):
            if m[1].upper() not in SQL_WORDS:
                yield Import(m[1], None, "table", line, True, m[0])
    for m, line in _matches(r"(?:CALL|EXEC|EXECUTE)\s+(\w+)", code, numbers, re.IGNORECASE):
        yield Import(m[1], None, "procedure", line, False, m[0])
    for m, line in _matches(r"(\w+)\.(\w+)\s*\(", code, numbers):
        if m[2].upper() not in ("SELECT", "FROM", "INSERT", "UPDATE", "DELETE"):
            yield Import(f"{m[1]}.{m[2]}", None, "function", line, True, m[0])


#: Texts that stand as Python strings at once.
AT_ONCE = 64

PARSERS: dict[str, Parser] = {
    "python": python_imports, "javascript": javascript_imports, "typescript": javascript_imports, "jsx": javascript_imports,
    "tsx": javascript_imports, "java": java_imports, "go": go_imports, "rust": rust_imports, "sql": sql_imports,
}


def register_parser(language: str, parser: Parser) -> None:
    PARSERS[language] = parser


def parse_imports(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """source_file, language and the import rows of files(path, language, content); languages without a parser have none."""
    table = dict(parsers or PARSERS)

    names = ["source_file", "language", *Import._fields]
    types = [pa.string()] * 5 + [pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                texts = zip(*(batch.column(c).slice(k, AT_ONCE).to_pylist() for c in ("path", "language", "content")), strict=True)
                rows = [(p, lang, *row) for p, lang, text in texts for row in table[lang](text or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    known = files.where(F.col("language").isin(*table)).select("path", "language", "content")
    return known.mapInArrow(run, f"source_file string, language string, {IMPORT_ROWS}")


def _dotted(module: Column) -> Column:
    return F.translate(module, ".", "/")


def _python_candidates(module: Column, source: Column) -> Column:
    """Also relative ones: each dot after the first goes up a folder."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    folders = F.split(source, "/")
    base = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots, F.lit(0))), "/")
    tail = _dotted(F.regexp_replace(module, r"^\.+", ""))
    inside = F.array_join(F.filter(F.array(base, tail), lambda x: x != ""), "/")
    stem = F.when(dots > 0, inside).otherwise(_dotted(module))
    return F.array(
        F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")), F.concat(F.lit("src/"), stem, F.lit(".py")),
        F.concat(F.lit("src/"), stem, F.lit("/__init__.py"))
    )


def _javascript_candidates(module: Column, source: Column) -> Column:
    """Relative modules lie at their place beside the source, with .. folded in; then a ladder of suffixes."""
    folder = F.slice(F.split(source, "/"), F.lit(1), F.greatest(F.size(F.split(source, "/")) - 1, F.lit(0)))
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    walked = F.aggregate(F.split(module, "/"), folder, lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.array_append(a, x)))
    stem = F.when(module.startswith("."), F.array_join(walked, "/")).otherwise(module)
    suffixes = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts", "/index.tsx")
    return F.array(*(F.concat(stem, F.lit(x)) for x in suffixes))


def _java_candidates(module: Column, source: Column) -> Column:
    return F.array(F.concat(F.lit("src/main/java/"), _dotted(module), F.lit(".java")), F.concat(_dotted(module), F.lit(".java")))


def _go_candidates(module: Column, source: Column) -> Column:
    parts = F.split(module, "/")
    return F.array(F.concat(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"), F.lit(".go")), F.concat(module, F.lit(".go")))


def _rust_candidates(module: Column, source: Column) -> Column:
    parts = F.filter(F.split(module, "::"), lambda x: ~x.isin("crate", "self", "super"))
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), module)
    return F.array(F.concat(F.lit("src/"), first, F.lit(".rs")), F.concat(F.lit("src/"), first, F.lit("/mod.rs")), F.concat(first, F.lit(".rs")))


def _sql_candidates(module: Column, source: Column) -> Column:
    return F.array(module, F.concat(module, F.lit(".sql")))


RESOLVERS: dict[str, Callable[[Column, Column], Column]] = {
    "python": _python_candidates, "javascript": _javascript_candidates, "typescript": _javascript_candidates, "jsx": _javascript_candidates,
    "tsx": _javascript_candidates, "java": _java_candidates, "go": _go_candidates, "rust": _rust_candidates, "sql": _sql_candidates,
}


def register_resolver(language: str, candidates: Callable[[Column, Column], Column]) -> None:
    RESOLVERS[language] = candidates


def resolve_imports(imports: DataFrame, files: DataFrame, trust_files: bool = True) -> DataFrame:
    """imports with target_file, the first candidate that is a path of files, or null. With trust_files an import that has one is internal."""
    candidates = F.array().cast("array<string>")
    for language, build in RESOLVERS.items():
        candidates = F.when(F.col("language") == language, build(F.col("module"), F.col("source_file"))).otherwise(candidates)
    module, name = F.col("module"), F.col("name")  # what a Python from-import names may itself be a file
    below = F.when(module.endswith("."), F.concat(module, name)).otherwise(F.concat(module, F.lit("."), name))
    python = RESOLVERS.get("python")
    if python:
        candidates = F.when(
            (F.col("language") == "python") & (F.col("kind") == "from") & name.isNotNull(),
            F.concat(candidates, python(below, F.col("source_file")))
        ).otherwise(candidates)
    keyed = imports.withColumn("__id", F.xxhash64("source_file", "module", "name", "kind", "line", "raw"))
    options = keyed.select("__id", F.posexplode(candidates).alias("pos", "path")).distinct()
    hits = options.join(files.select("path").distinct(), "path").groupBy("__id").agg(F.min_by("path", "pos").alias("target_file"))
    out = keyed.join(hits, "__id", "left").drop("__id")
    return out.withColumn("is_external", F.col("is_external") & F.col("target_file").isNull()) if trust_files else out

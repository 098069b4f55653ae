"""Symbols of source files, calls between them, and signatures: table functions and lookups."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.imports import code_lines
from codequarry.schemas import SYMBOL_KINDS, SYMBOL_ROWS


class Symbol(NamedTuple):
    id: str
    name: str
    kind: str
    line: int
    end_line: int
    signature: str
    doc: str


Finder = Callable[[str, str], Iterator[Symbol]]


def _at(path: str, name: str, kind: str, line: int, signature: str, shown: str | None = None) -> Symbol:
    return Symbol(f"{path}:{name}:{line}", shown or name, kind, line, line, signature, "")


def python_symbols(path: str, text: str) -> Iterator[Symbol]:
    """Functions with their parameters and result, classes with their bases, and variables assigned by name."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            yield Symbol(
                f"{path}:{node.name}:{node.lineno}", node.name, "function", node.lineno, node.end_lineno,
                f"def {node.name}({ast.unparse(node.args)}){result}", ast.get_docstring(node) or ""
            )
        elif isinstance(node, ast.ClassDef):
            bases = f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else ""
            yield Symbol(
                f"{path}:{node.name}:{node.lineno}", node.name, "class", node.lineno, node.end_lineno, f"class {node.name}{bases}",
                ast.get_docstring(node) or ""
            )
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    yield _at(path, target.id, "variable", node.lineno, "")


def javascript_symbols(path: str, text: str) -> Iterator[Symbol]:
    for number, line in code_lines(text, "//"):
        for m in re.finditer(r"function\s+(\w+)\s*\([^)]*\)", line):
            yield _at(path, m[1], "function", number, f"function {m[1]}(...)")
        for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=", line):
            yield _at(path, m[1], "variable", number, "")
        for m in re.finditer(r"class\s+(\w+)\s*\{", line):
            yield _at(path, m[1], "class", number, f"class {m[1]}")


_JAVA_WORDS = ("if", "while", "for", "switch", "class", "interface", "return", "new", "else", "throw")


def java_symbols(path: str, text: str) -> Iterator[Symbol]:
    """Indented members count too; a call behind return or new is no method."""
    for number, line in enumerate(text.split("\n"), 1):
        line = line.split("//", 1)[0].strip()
        if m := re.match(r"(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)", line):
            yield _at(path, m[1], "class", number, f"class {m[1]}")
        elif (
            m := re.match(r"(?:(?:public|private|protected|static|final)\s+)*([\w<>\[\],]+)\s+(\w+)\s*\(", line)
        ) and m[1] not in _JAVA_WORDS and m[2] not in _JAVA_WORDS:
            yield _at(path, m[2], "method", number, f"{m[2]}(...)")


def _by_line(patterns: tuple[tuple[str, str, str, str], ...]) -> Finder:
    """Finder of (pattern, kind, signature prefix, prefix of the shown name) at the start of lines; the signature of a function ends in (...)."""

    def find(path: str, text: str) -> Iterator[Symbol]:
        for number, line in enumerate(text.split("\n"), 1):
            if line.strip().startswith("//"):
                continue
            for pattern, kind, prefix, shown in patterns:
                if m := re.match(pattern, line):
                    yield _at(path, m[1], kind, number, f"{prefix} {m[1]}" + "(...)" * (kind == "function"), shown + m[1])

    return find


go_symbols = _by_line(
    (
        (r"func\s+(\w+)\s*\(", "function", "func", ""), (r"type\s+(\w+)\s+struct", "class", "type", ""),
        (r"type\s+(\w+)\s+interface", "interface", "type", "")
    )
)
rust_symbols = _by_line(
    (
        (r"fn\s+(\w+)\s*\(", "function", "fn", ""), (r"struct\s+(\w+)", "class", "struct", ""), (r"enum\s+(\w+)", "class", "enum", ""),
        (r"impl\s+(?:<[^>]+>)?\s*(\w+)", "class", "impl", "impl_")
    )
)

FINDERS: dict[str, Finder] = {
    "python": python_symbols, "javascript": javascript_symbols, "typescript": javascript_symbols, "java": java_symbols, "go": go_symbols,
    "rust": rust_symbols
}


def register_symbols(language: str, finder: Finder) -> None:
    FINDERS[language] = finder


def parse_symbols(files: DataFrame, finders: dict[str, Finder] | None = None) -> DataFrame:
    """file, language and the symbol rows of files(path, language, content)."""
    table = dict(finders or FINDERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, lang, *s) for p, lang, text in zip(pdf["path"], pdf["language"], pdf["content"]) for s in table[lang](p, text or "")]
            yield pd.DataFrame(rows, columns=["file", "language", *Symbol._fields])

    return files.where(F.col("language").isin(*table)).select("path", "language", "content").mapInPandas(run, f"file string, language string, {SYMBOL_ROWS}")


def python_calls(text: str) -> Iterator[tuple[str, str, int]]:
    """(caller, callee, line) of calls inside functions; the caller is the innermost function around the call."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            owner = node.name
        if isinstance(node, ast.Call) and owner:
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                yield owner, name, node.lineno
        todo += [(child, owner) for child in ast.iter_child_nodes(node)]


def call_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target, edge_type, line: calls from a symbol to another known one. Python callers are lexical; a JavaScript
    method call belongs to the last function that begins before it (an as-of join, as a running maximum over lines)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *c) for p, text in zip(pdf["path"], pdf["content"]) for c in python_calls(text or "")]
            yield pd.DataFrame(rows, columns=["file", "caller", "callee", "line"])

    python = files.where("language = 'python'").select("path", "content").mapInPandas(run, "file string, caller string, callee string, line int")
    lines = files.where("language in ('javascript', 'typescript')").select(
        F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("no", "text")
    ).withColumn("line", F.col("no") + 1)
    calls = lines.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\.(\w+)\s*\("), F.lit(1))).alias("callee"))
    functions = symbols.where("kind = 'function' and language in ('javascript', 'typescript')").select("file", "line", F.col("name").alias("caller"))
    timeline = calls.select("file", "line", "callee", F.lit(None).cast("string").alias("caller")).unionByName(
        functions.select("file", "line", F.lit(None).cast("string").alias("callee"), "caller")
    )
    before = Window.partitionBy("file").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    owned = timeline.withColumn("caller", F.coalesce(F.last("caller", ignorenulls=True).over(before), "caller")).where("callee is not null and caller is not null")
    both = python.select("file", "caller", "callee", "line").union(owned.select("file", "caller", "callee", "line"))
    named = symbols.groupBy("name").agg(F.max("id").alias("target"))
    own = symbols.groupBy("file", "name").agg(F.max("id").alias("source"))
    return both.join(
        own, (both["file"] == own["file"]) & (both["caller"] == own["name"])
    ).select("source", "callee", both["line"]).join(named, F.col("callee") == F.col("name")).select("source", "target", F.lit("calls").alias("edge_type"), "line")


def kind_counts(symbols: DataFrame, zeros: bool = True) -> DataFrame:
    """Number of symbols of each kind; all kinds stand, with zeros."""
    kinds = symbols.sparkSession.createDataFrame([(k,) for k in SYMBOL_KINDS], "kind string")
    counted = symbols.groupBy("kind").agg(F.count("*").alias("n"))
    out = kinds.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
    return out if zeros else out.where("n > 0")


def symbol_density(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file").agg(F.count("*").alias("n_symbols"))

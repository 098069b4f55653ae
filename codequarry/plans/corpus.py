"""A code corpus dealt out over documents, the same in both dialects of the catalog: files of each parser's language, with resolvable, external,
repeated and cyclic imports, comments, blank-line breaks, and a file long enough to be cut by structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LONG = "class Store {\n" + "".join(f"function load{i}(a, b) {{\n  const value{i} = a + b * {i};\n  return helper.run(value{i});\n}}\n" for i in range(60)) + "}\n"

FILES: list[tuple[str, str, str]] = [
    (
        "src/core/main.py", "python",
        "import os\nimport utils\nfrom src.core import models\nfrom . import helper\nimport utils\n\ndef run(x: int) -> str:\n    return helper.show(x)\n\nclass App(Base):\n    def start(self):\n        run(1)\n"
    ),
    ("src/core/models.py", "python", "from src.core.main import run\nimport json\nLIMIT = 5\n"),
    ("src/core/helper.py", "python", "import src.core.models\ndef show(x):\n    return x\n"),
    ("utils.py", "python", "import sys\nimport utils\n" + "\n".join(f"V{i} = {i}" + ("\n" if i % 7 == 6 else "") for i in range(40))),
    (
        "web/app.js", "javascript",
        "import a from './lib/a'\nimport {b} from \"react\"\n// import c from 'gone'\nconst fs = require('fs')\n/* block\nimport d from 'hidden'\n*/\nfunction start() {\n  a.load()\n}\nclass Shell {\n}\n"
    ),
    ("web/lib/a.js", "javascript", "import app from '../app'\nfunction load() {}\nfunction save() {\n  store.load()\n}\n"),
    (
        "src/main/java/a/B.java", "java",
        "package a;\nimport java.util.List;\nimport static a.C.run;\nimport a.C;\npublic class B {\n    public void go(int x) {\n        return run(x);\n    }\n}\n"
    ),
    ("src/main/java/a/C.java", "java", "import a.B;\nclass C {\n  static int run(int x) { return x; }\n}\n"),
    (
        "cmd/main.go", "go",
        "package main\nimport \"fmt\"\nimport (\n  \"example.org/app/cmd/util\"\n  \"os\"\n)\nfunc main() {\n}\ntype Box struct {\n}\ntype Shape interface {\n}\n"
    ),
    ("cmd/util.go", "go", "package util\nfunc Help() {\n}\n"),
    ("src/lib.rs", "rust", "mod shapes;\nuse std::fmt;\nuse crate::shapes::Circle; // note\nfn area() {\n}\nstruct Dot {\n}\nenum Kind {\n}\nimpl Dot {\n}\n"),
    ("src/shapes.rs", "rust", "pub struct Circle {}\nuse super::Dot;\n"),
    (
        "db/all.sql", "sql",
        "-- comment\n\\i tables.sql\nSELECT * FROM users JOIN orders ON users.id = orders.uid;\nEXEC refresh_all\nINSERT INTO log SELECT audit.note(1);\n"
    ),
    ("tables.sql", "sql", "CREATE TABLE IF NOT EXISTS users (id INT);\nDROP TABLE old_users;\n"),
    ("web/store.js", "javascript", _LONG),
    ("notes.xyz", "unknown", "import nothing\n"),
]

#: The import rows of the files above, as read off by hand: file, language, module, name, kind, line, external, statement.
IMPORTED: list[tuple] = [
    ("src/core/main.py", "python", "os", None, "import", 1, True, "import os"),
    ("src/core/main.py", "python", "utils", None, "import", 2, True, "import utils"),
    ("src/core/main.py", "python", "src.core", "models", "from", 3, True, "from src.core import models"),
    ("src/core/main.py", "python", ".", "helper", "from", 4, False, "from . import helper"),
    ("src/core/main.py", "python", "utils", None, "import", 5, True, "import utils"),
    ("src/core/models.py", "python", "src.core.main", "run", "from", 1, True, "from src.core.main import run"),
    ("src/core/models.py", "python", "json", None, "import", 2, True, "import json"),
    ("src/core/helper.py", "python", "src.core.models", None, "import", 1, True, "import src.core.models"),
    ("utils.py", "python", "sys", None, "import", 1, True, "import sys"),
    ("utils.py", "python", "utils", None, "import", 2, True, "import utils"),
    ("web/app.js", "javascript", "./lib/a", None, "import", 1, True, "import a from './lib/a'"),
    ("web/app.js", "javascript", "react", None, "import", 2, True, 'import {b} from "react"'),
    ("web/app.js", "javascript", "fs", None, "require", 4, True, "require('fs')"),
    ("web/lib/a.js", "javascript", "../app", None, "import", 1, True, "import app from '../app'"),
    ("src/main/java/a/B.java", "java", "java.util.List", None, "import", 2, True, "import java.util.List;"),
    ("src/main/java/a/B.java", "java", "a.C.run", None, "static", 3, True, "import static a.C.run;"),
    ("src/main/java/a/B.java", "java", "a.C", None, "import", 4, True, "import a.C;"),
    ("src/main/java/a/C.java", "java", "a.B", None, "import", 1, True, "import a.B;"),
    ("cmd/main.go", "go", "fmt", None, "import", 2, True, 'import "fmt"'),
    ("cmd/main.go", "go", "example.org/app/cmd/util", None, "import", 4, True, '"example.org/app/cmd/util"'),
    ("cmd/main.go", "go", "os", None, "import", 5, True, '"os"'),
    ("src/lib.rs", "rust", "shapes", None, "mod", 1, False, "mod shapes;"),
    ("src/lib.rs", "rust", "std::fmt", None, "import", 2, True, "use std::fmt;"),
    ("src/lib.rs", "rust", "crate::shapes::Circle", None, "import", 3, False, "use crate::shapes::Circle;"),
    ("src/shapes.rs", "rust", "super::Dot", None, "import", 2, False, "use super::Dot;"),
    ("db/all.sql", "sql", "tables.sql", None, "sql_file", 2, False, "\\i tables.sql"),
    ("db/all.sql", "sql", "users", None, "table", 3, True, "FROM users"),
    ("db/all.sql", "sql", "orders", None, "table", 3, True, "JOIN orders"),
    ("db/all.sql", "sql", "refresh_all", None, "procedure", 4, False, "EXEC refresh_all"),
    ("db/all.sql", "sql", "log", None, "table", 5, True, "INSERT INTO log"),
    ("db/all.sql", "sql", "audit", None, "table", 5, True, "SELECT audit"),
    ("db/all.sql", "sql", "audit.note", None, "function", 5, True, "audit.note("),
    ("tables.sql", "sql", "users", None, "table", 1, True, "CREATE TABLE IF NOT EXISTS users"),
    ("tables.sql", "sql", "old_users", None, "table", 2, True, "DROP TABLE old_users"),
]
#: What the files above import, as read off by hand: file, language, module, line, file it resolves to, external.
RESOLVED: list[tuple] = [
    ("src/core/main.py", "python", "os", 1, None, "true"), ("src/core/main.py", "python", "utils", 2, "utils.py", "false"), (
        "src/core/main.py", "python", "src.core", 3, "src/core/models.py", "false"
    ),
    ("src/core/main.py", "python", ".", 4, "src/core/helper.py", "false"), ("src/core/main.py", "python", "utils", 5, "utils.py", "false"), (
        "src/core/models.py", "python", "src.core.main", 1, "src/core/main.py", "false"
    ),
    ("src/core/models.py", "python", "json", 2, None, "true"), (
        "src/core/helper.py", "python", "src.core.models", 1, "src/core/models.py", "false"
    ), ("utils.py", "python", "sys", 1, None, "true"), ("utils.py", "python", "utils", 2, "utils.py", "false"),
    (
        "web/app.js", "javascript", "./lib/a", 1, "web/lib/a.js", "false"
    ), ("web/app.js", "javascript", "react", 2, None, "true"), ("web/app.js", "javascript", "fs", 4, None, "true"), ("web/lib/a.js", "javascript", "../app", 1, "web/app.js", "false"),
    ("src/main/java/a/B.java", "java", "java.util.List", 2, None, "true"), ("src/main/java/a/B.java", "java", "a.C.run", 3, None, "true"), (
        "src/main/java/a/B.java", "java", "a.C", 4, "src/main/java/a/C.java", "false"
    ),
    (
        "src/main/java/a/C.java", "java", "a.B", 1, "src/main/java/a/B.java", "false"
    ), ("cmd/main.go", "go", "fmt", 2, None, "true"), ("cmd/main.go", "go", "example.org/app/cmd/util", 4, "cmd/util.go", "false"), ("cmd/main.go", "go", "os", 5, None, "true"),
    ("src/lib.rs", "rust", "shapes", 1, "src/shapes.rs", "false"), ("src/lib.rs", "rust", "std::fmt", 2, None, "true"), (
        "src/lib.rs", "rust", "crate::shapes::Circle", 3, "src/shapes.rs", "false"
    ), ("src/shapes.rs", "rust", "super::Dot", 2, None, "false"),
    (
        "db/all.sql", "sql", "tables.sql", 2, "tables.sql", "false"
    ), ("db/all.sql", "sql", "users", 3, None, "true"), ("db/all.sql", "sql", "orders", 3, None, "true"), ("db/all.sql", "sql", "refresh_all", 4, None, "false"), ("db/all.sql", "sql", "log", 5, None, "true"),
    ("db/all.sql", "sql", "audit", 5, None, "true"), (
        "db/all.sql", "sql", "audit.note", 5, None, "true"
    ), ("tables.sql", "sql", "users", 1, None, "true"), ("tables.sql", "sql", "old_users", 2, None, "true"),
]
#: Symbols of all files but the two generated ones: file, name, kind, line.
NAMED: list[tuple] = [
    ("src/core/main.py", "run", "function", 7), ("src/core/main.py", "App", "class", 10), ("src/core/main.py", "start", "function", 11), (
        "src/core/models.py", "LIMIT", "variable", 3
    ), ("src/core/helper.py", "show", "function", 2),
    ("web/app.js", "fs", "variable", 4), ("web/app.js", "start", "function", 8), ("web/app.js", "Shell", "class", 11), ("web/lib/a.js", "load", "function", 2), ("web/lib/a.js", "save", "function", 3), (
        "src/main/java/a/B.java", "B", "class", 5
    ),
    ("src/main/java/a/B.java", "go", "method", 6), ("src/main/java/a/C.java", "C", "class", 2), (
        "src/main/java/a/C.java", "run", "method", 3
    ), ("cmd/main.go", "main", "function", 7), ("cmd/main.go", "Box", "class", 9), ("cmd/main.go", "Shape", "interface", 11),
    ("cmd/util.go", "Help", "function", 2), ("src/lib.rs", "area", "function", 4), ("src/lib.rs", "Dot", "class", 6), ("src/lib.rs", "Kind", "class", 8), (
        "src/lib.rs", "impl_Dot", "class", 10
    ),
]
GENERATED = ("web/store.js", "utils.py")
#: Calls in the hand-written files: file, caller, callee, line.
CALLED: list[tuple] = [("src/core/main.py", "start", "run", 12), ("src/core/main.py", "run", "show", 8), ("web/app.js", "start", "load", 9), ("web/lib/a.js", "save", "load", 4)]
#: Kinds of symbols of all files, with their numbers.
KINDS: list[tuple] = [(r[0], r[2], 1) for r in NAMED] + [("web/store.js", "function", 60), ("web/store.js", "class", 1), ("web/store.js", "variable", 60), ("utils.py", "variable", 40)]

CATEGORIES = [("root", "", "Docs"), ("guide", "root", "Guide"), ("api", "root", "API"), ("auth", "api", "Auth"), ("tokens", "auth", "Tokens"), ("alone", None, "Alone")]
STEPS = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("x", 6), ("y", 7), ("z", 8)]
NEEDS = [("a", "c"), ("b", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("e", "unknown")]
CALLS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "c"), ("a", "d"), ("f", "a"), ("d", "d")]
PATHS = [
    "src/main.py", "Makefile", "docker/Dockerfile.dev", "a/b/c.min.js", "lib/x/y.TSX", ".env", "README.md", "cmd/tool.go", "notes", "img/logo.PNG",
    "node_modules/p/index.js", "pkg/only.go", "app/views/page.vue", "deep/src/a.rs", "x/FooDto.java", "x/BarService.java", "y/AppConfig.java", "scripts/run.sh", "a.b.c/file.tar.gz", "web.egg-info/x.py",
]
MARKDOWN = [
    (
        1, "# Title & more\n\ntext **bold** and `code` <tag>\n- item\n1. first\n> quote"
    ), (2, "```python\nx = \"<a>\"\n```\nafter"), (3, "```mermaid\ngraph TD\n```"), (4, "## Two [link](http://a?b=1&c=2)\n### Three\n```\nplain\n```\n```open\nlost"),
]
#: Address before and after a document's number; host, owner, and repository before the number.
URLS = [
    ("https://github.com/acme/tool", ".git", "github.com", "acme", "tool"), ("gitlab.com/group/lib", "/", "gitlab.com", "group", "lib"),
    ("https://example.org/acme/tool", "", "", "", ""), (" http://www.bitbucket.org/team/repo", "?x=1 ", "bitbucket.org", "team", "repo"),
]


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A DuckDB table expression of the rows."""
    cell = lambda v: str(v).lower() if isinstance(v, bool) else quoted(v) if v is None or isinstance(v, str) else "[" + ", ".join(quoted(x) for x in v) + "]::VARCHAR[]" if isinstance(v, list) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


def listed_files(spark: SparkSession) -> DataFrame:
    """The files as they are listed."""
    return spark.createDataFrame(FILES, "path string, language string, content string")


LISTED_SQL = "code AS (SELECT * FROM " + values(FILES, "path, language, content") + ")"

# ---- corpora dealt out over documents -------------------------------------------------------------
# Document d takes row d % n of a list of n, under the folder p<d // n>, so a corpus has a row for each document, whole texts included.


def dealt(documents: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """doc_id, text, folder, and the row that each document takes."""
    n = len(rows)
    options = F.array(*(F.struct(*(F.lit(v).cast("string").alias(c) for v, c in zip(r, names, strict=True))) for r in rows))
    place = F.pmod(F.col("doc_id"), F.lit(n))
    row = F.get(options, place.cast("int")).alias("row")
    return documents.select("doc_id", "text", F.concat(F.lit("p"), F.floor(F.col("doc_id") / n).cast("string"), F.lit("/")).alias("folder"), row).select("doc_id", "text", "folder", "row.*")


def dealt_sql(rows: list[tuple], names: str, n: int) -> str:
    """documents with the rows (the first column tells the number of the row that they belong to) they take; a document may take several."""
    return f"documents JOIN {values(rows, 'k, ' + names).replace(' AS t(', ' AS x(')} ON doc_id % {n} = x.k"


FOLDER_SQL = "'p' || doc_id // {n} || '/'"


def paths(documents: DataFrame) -> DataFrame:
    return dealt(documents, [(p,) for p in PATHS], ["name"]).select(F.concat("folder", "name").alias("path"))


PATHS_SQL = f"(SELECT {FOLDER_SQL.format(n=len(PATHS))} || x.name AS path FROM {dealt_sql([(i, p) for i, p in enumerate(PATHS)], 'name', len(PATHS))}) AS t"

#: How lines of a document's text stand as comments at the end of a file.
COMMENTS = {"python": "# ", "javascript": "// ", "java": "// ", "go": "// ", "rust": "// ", "sql": "-- ", "unknown": ""}


def code_files(documents: DataFrame) -> DataFrame:
    """path, language, content: the file that each document takes, with the document's text as comments behind it."""
    rows = dealt(documents, [(p, x, c, COMMENTS[x]) for p, x, c in FILES], ["name", "language", "content", "mark"])
    text = F.coalesce("text", F.lit(""))
    comment = F.concat("mark", F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), "mark")), F.lit("\n"))
    return rows.select(F.concat("folder", "name").alias("path"), "language", F.concat("content", comment).alias("content"))


def hand_written(path: Column) -> Column:
    """Whether a path is none of the generated files'."""
    return ~F.substring_index(path, "/", -1).isin(*(p.split("/")[-1] for p in GENERATED))


CODE_SQL = f"""code AS (SELECT {FOLDER_SQL.format(n=len(FILES))} || x.name AS path, x.language,
x.content || x.mark || replace(coalesce(text, ''), chr(10), chr(10) || x.mark) || chr(10) AS content
FROM {dealt_sql([(i, p, x, c, COMMENTS[x]) for i, (p, x, c) in enumerate(FILES)], 'name, language, content, mark', len(FILES))})"""
#: Number of each file.
FILE_NUMBER = {p: i for i, (p, _, _) in enumerate(FILES)}


def by_file(rows: list[tuple], names: str) -> str:
    """documents with the rows (file first) of the file that they take; `folder` stands before each file's name."""
    n = len(FILES)
    return f"(SELECT {FOLDER_SQL.format(n=n)} AS folder, doc_id // {n} AS project, x.* FROM {dealt_sql([(FILE_NUMBER[r[0]], *r) for r in rows], names, n)})"

"""Operators against expectations written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codequarry.functions import files as f
from codequarry.operators import chunking, docmap, graph, imports, index, render, state, symbols
from codequarry.sources import files as sources
from codequarry.sources.sinks import write_markdown


def rows(df, *cols):  # noqa: ANN001, ANN201
    return sorted(tuple(r) for r in df.select(*cols).collect())


def parse(spark, language, text, path="f"):  # noqa: ANN001, ANN201
    return imports.parse_imports(spark.createDataFrame([(path, language, text)], "path string, language string, content string"))


def test_python_imports(spark):  # noqa: ANN001
    text = "import os\nfrom collections import OrderedDict, namedtuple\nfrom . import utils\nfrom .. import parent\nfrom .utils import helper\nimport numpy\n"
    got = {(r.module, r.name, r.kind, r.is_external) for r in parse(spark, "python", text).collect()}
    assert got == {
        ("os", None, "import", True), ("collections", "OrderedDict", "from", True), ("collections", "namedtuple", "from", True),
        (".", "utils", "from", False), ("..", "parent", "from", False), (".utils", "helper", "from", False), ("numpy", None, "import", True)
    }
    assert parse(spark, "python", "def broken(:").count() == 0


def test_other_imports(spark):  # noqa: ANN001
    assert rows(
        parse(
            spark, "javascript",
            "const fs = require('fs')\nimport a from './x'\n// import b from 'no'\n/*\nimport c from 'no'\n*/\nimport 'side'"
        ),
        "module", "kind", "line"
    ) == [("./x", "import", 2), ("fs", "require", 1), ("side", "import", 7)]
    assert rows(
        parse(spark, "java", "import java.util.List;\nimport java.util.*;\nimport static a.B.c;"), "module", "kind"
    ) == [("a.B.c", "static"), ("java.util", "import"), ("java.util.List", "import")]
    assert rows(parse(spark, "go", 'import "fmt"\nimport (\n "os"\n "a/b"\n)\n'), "module", "line") == [("a/b", 4), ("fmt", 1), ("os", 3)]
    found = rows(parse(spark, "sql", "SELECT * FROM users JOIN orders ON users.id = orders.user_id;\nEXEC usp_GetOrders\n\\i other.sql\n"), "module", "kind")
    assert {("users", "table"), ("orders", "table"), ("usp_GetOrders", "procedure"), ("other.sql", "sql_file")} <= set(found)
    assert parse(spark, "cobol", "COPY x").count() == 0


def test_registered_languages(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(imports, "PARSERS", dict(imports.PARSERS))
    monkeypatch.setattr(imports, "RESOLVERS", dict(imports.RESOLVERS))
    monkeypatch.setattr(symbols, "FINDERS", dict(symbols.FINDERS))
    kind = imports.Import

    def copies(text):  # noqa: ANN001, ANN202
        for n, line in enumerate(text.split("\n"), 1):
            if line.startswith("COPY "):
                yield kind(line[5:], None, "copy", n, True, line)

    def programs(path, text):  # noqa: ANN001, ANN202
        for n, line in enumerate(text.split("\n"), 1):
            if line.startswith("PROGRAM "):
                yield symbols._at(path, line[8:], "class", n, line)

    imports.register_parser("cobol", copies)
    imports.register_resolver("cobol", lambda module, source: F.array(F.concat(F.lower(module), F.lit(".cpy"))))
    symbols.register_symbols("cobol", programs)
    code = spark.createDataFrame([("a.cob", "cobol", "PROGRAM A\nCOPY X\nCOPY Y"), ("x.cpy", "text", "")], "path string, language string, content string")
    got = imports.resolve_imports(imports.parse_imports(code), code)
    assert rows(got, "module", "line", "target_file", "is_external") == [("X", 2, "x.cpy", False), ("Y", 3, None, True)]
    assert rows(symbols.parse_symbols(code), "name", "kind", "line") == [("A", "class", 1)]
    own = {"cobol": lambda text: iter(())}
    assert imports.parse_imports(code, own).count() == 0


def test_resolution_takes_the_first_candidate(spark):  # noqa: ANN001
    code = spark.createDataFrame(
        [
            ("src/main.py", "python", "import utils\nimport os\nfrom . import helper\n"), ("utils.py", "python", ""),
            ("src/utils.py", "python", ""), ("src/helper.py", "python", "")
        ],
        "path string, language string, content string"
    )
    got = {(r.module, r.name): (r.target_file, r.is_external) for r in imports.resolve_imports(imports.parse_imports(code), code).collect()}
    assert got[("utils", None)] == ("utils.py", False)
    assert got[("os", None)] == (None, True)


def test_index(spark):  # noqa: ANN001
    files = spark.createDataFrame([("main.py", "python", 3), ("utils/helper.py", "python", 5), ("other.py", "python", 2)], "path string, language string, lines long")
    links = spark.createDataFrame(
        [
            ("main.py", "utils.helper", "utils/helper.py", False), ("other.py", "utils.helper", "utils/helper.py", False),
            ("main.py", "os", None, True)
        ],
        "source_file string, target_module string, target_file string, is_external boolean"
    )
    assert rows(index.entry_points(files, links), "path") == [("main.py",), ("other.py",)]
    assert rows(index.module_dependencies(links), "src_module", "dst_module") == [("root", "utils")]
    assert rows(index.importers_of(links, "utils/helper.py"), "source_file") == [("main.py",), ("other.py",)]
    assert rows(index.external_modules(links), "target_module") == [("os",)]
    assert index.statistics(files, links).first().total_imports == 3


def test_graph(spark):  # noqa: ANN001
    chain = spark.createDataFrame([("main", "utils"), ("utils", "models"), ("utils", "models"), ("models", "models")], "src string, dst string")
    start = spark.createDataFrame([("main",)], "id string")
    one, two = rows(graph.related(chain, start, 1), "id"), rows(graph.related(chain, start, 2), "id")
    assert one == [("utils",)] and two == [("models",), ("utils",)] and set(one) <= set(two)
    ranks = graph.page_rank(start, chain)
    assert abs(ranks.agg(F.sum("score")).first()[0] - 1) < 1e-6 and ranks.count() == 3
    assert graph.page_rank(start.where("false"), chain.where("false")).count() == 0
    assert rows(graph.call_chains(chain, "main", "main"), "chain") == [(["main"],)]


def test_chunks_partition_lines(spark):  # noqa: ANN001
    text = "\n".join("" if i % 13 == 12 else f"line {i}" for i in range(100))
    got = chunking.line_chunks(spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "path string, content string")).orderBy("path", "chunk_no").collect()
    assert [r.path for r in got] == ["a"] * len(got)
    covered = [n for r in got for n in range(r.start_line, r.end_line + 1)]
    assert covered == list(range(1, 101))
    assert all(r.end_line - r.start_line < 30 for r in got)
    code = "class A:\n" + "".join(f"def f{i}():\n" + "    x = 1\n" * 60 for i in range(20))
    parts = chunking.structural_chunks(spark.createDataFrame([("a", code)], "path string, content string")).orderBy("start_line").collect()
    assert "\n".join(r.content for r in parts) == code and len(parts) > 3 and parts[0].chunk_name == "A"


def test_scan(spark, tmp_path):  # noqa: ANN001
    for name, content in {
        "src/main.js": "let a = 1\n", "app.js": "x", "app.min.js": "x", "node_modules/p.js": "x", "static/chunk.js": "x" * 5000,
        "bin.dat": "x", "zero.py": "", "null.py": "a\0b"
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    got = sources.scan_directory(spark, str(tmp_path)).collect()
    assert [r.path for r in got] == ["src/main.js", "app.js"] and got[0].lines == 2 and got[0].is_entrypoint


def test_symbols(spark):  # noqa: ANN001
    text = 'class A(B):\n    """Doc."""\n    def go(self, x: int) -> str:\n        return show(x)\n\ndef show(x):\n    return x\n'
    code = spark.createDataFrame([("a.py", "python", text)], "path string, language string, content string")
    found = symbols.parse_symbols(code)
    assert rows(found, "name", "kind", "signature") == [
        ("A", "class", "class A(B)"), ("go", "function", "def go(self, x: int) -> str"), ("show", "function", "def show(x)")
    ]
    assert rows(symbols.call_edges(code, found), "source", "target") == [("a.py:go:3", "a.py:show:6")]
    assert symbols.kind_counts(found).count() == 8


def test_state_and_sinks(spark, tmp_path):  # noqa: ANN001
    log = spark.createDataFrame([("a", 1, "put", "x"), ("a", 5, "put", "y"), ("b", 9, "delete", "z")], "key string, created_at long, op string, value string")
    kept = state.alive(state.latest(log), F.lit(10))
    assert rows(kept, "key", "value") == [("a", "y")]
    pages = spark.createDataFrame([("one", "1"), ("dir/two", "2")], "id string, content string")
    record = write_markdown(pages, str(tmp_path))
    assert (tmp_path / "content/dir/two.md").read_text() == "2"
    assert rows(state.changed(spark.createDataFrame([("one", "1"), ("dir/two", "new")], "id string, content string"), record), "id") == [("dir/two",)]


def test_export_modes(spark, tmp_path):  # noqa: ANN001
    import json

    from codequarry.sources import sinks

    shape = "id string, title string, content string, parent_id string, ord int"
    pages = spark.createDataFrame([("index", "Overview", "1", "", 0), ("docs/a", "A", "2", "index", 1)], shape)
    bar = spark.createDataFrame([("- [Overview](content/index.md)",)], "text string")
    out = str(tmp_path)
    sinks.export_markdown(pages, bar, out, "Demo")
    assert (tmp_path / "_sidebar.md").read_text() == "# Demo\n\n- [Overview](content/index.md)\n"
    (tmp_path / "content/index.md").write_text("touched")
    changed = spark.createDataFrame([("index", "Overview", "1", "", 0), ("docs/a", "A", "3", "index", 1)], shape)
    record = sinks.export_markdown(changed, bar, out, "Demo", "incremental")
    assert (tmp_path / "content/index.md").read_text() == "touched" and (tmp_path / "content/docs/a.md").read_text() == "3"
    assert rows(sinks.read_record(spark, out), "id", "hash") == rows(record, "id", "hash")
    sinks.export_markdown(changed.where("id = 'index'"), bar, out, "Demo")
    assert (tmp_path / "content/index.md").read_text() == "1" and not (tmp_path / "content/docs/a.md").exists()
    (tmp_path / sinks.RECORD).write_text("{broken")
    assert sinks.read_record(spark, out) is None
    step = lambda *ns: [{"kind": 1, "ord": n, "id": str(n)} for n in ns]
    entries = spark.createDataFrame(
        [
            (step(1), 0, "Top", ""), (step(1, 1), 1, "Sub", "category/s"), (step(1, 1, 2), 2, "Leaf", "docs/l"),
            (step(1, 3), 1, "Other", "docs/o"), (step(2), 0, "Last", "dependencies")
        ],
        "sort_path array<struct<kind:int,ord:int,id:string>>, depth int, title string, page_id string"
    )
    doc = json.loads(sinks.json_document(pages, entries, "Demo").first().json)
    assert [p["id"] for p in doc["pages"]] == ["index", "docs/a"] and doc["project_name"] == "Demo"
    top, last = doc["sidebar"]
    assert [c["title"] for c in top["children"]] == ["Sub", "Other"] and top["children"][0]["children"] == [
        {"title": "Leaf", "page_id": "docs/l"}
    ] and "children" not in last


def test_rank_reads_its_edges_once_a_turn(spark, monkeypatch):  # noqa: ANN001
    seen = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [src")) or keep(df))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "x")], "src string, dst string")
    got = {r.id: r.score for r in graph.page_rank(edges.select(F.col("src").alias("id")), edges, most=5, tolerance=0).collect()}
    score, out = dict.fromkeys("abcdx", 0.2), {"a": "bx", "b": "c", "c": "a", "d": "c"}
    for _ in range(5):
        given = {v: sum(score[u] / len(t) for u, t in out.items() if v in t) for v in score}
        score = {v: 0.85 * (given[v] + score["x"] / 5) + 0.03 for v in score}
    assert all(abs(got[v] - score[v]) < 1e-12 for v in score) and len(got) == 5
    assert seen == [0, 0, 1, 1, 1, 1, 1]  # edges, first scores, turns


def test_stream_of_a_file_and_of_a_folder_of_parts(spark, tmp_path):  # noqa: ANN001
    from codequarry.plans.queries import QUERIES

    for d, parts in (("one", 1), ("several", 3)):
        docs = spark.createDataFrame([(i, "en" if i % 3 else "de", i) for i in range(12)], "doc_id long, lang string, n_chars long").repartition(parts)
        docs.write.parquet(str(tmp_path / d / "documents.parquet"))
        docs.write.parquet(str(tmp_path / d / "documents_old.parquet"))
    (part,) = (tmp_path / "one" / "documents.parquet").glob("part-*")
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "documents.parquet")
    for d in ("file", "several"):
        assert rows(QUERIES["streaming_file_ingest"](spark, str(tmp_path / d)), "lang", "n_docs", "n_chars") == [("de", 4, 18), ("en", 8, 48)]


def test_cache_as_a_stream(spark, tmp_path):  # noqa: ANN001
    from codequarry.streaming import ingest

    shape = "key string, value string, created_at timestamp, op string"
    at = lambda day, hour=0: f"2024-01-{day:02d} {hour:02d}:00:00"
    batches = [
        [
            ("a", "1", at(1), "put"), ("a", "2", at(1, 5), "put"), ("b", "x", at(2), "put"), ("c", "y", at(2), "put")
        ], [("a", "old", at(1, 2), "put"), ("c", None, at(3), "delete")],
        [("d", "z", at(20), "put")], [("d", "w", at(21), "put")],
    ]
    seen: list = []
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "key string, value string, created_at string, op string").withColumn("created_at", F.col("created_at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "log"))
        ingest.drain(ingest.cached_values(stream), lambda df, _: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "check"))
        if n == 0:
            assert sorted((k, v, live) for k, v, _, live in seen) == [("a", "2", True), ("b", "x", True), ("c", "y", True)]
    told = [(k, v, live) for k, v, _, live in seen]
    assert ("a", "old", True) not in told and ("c", None, False) in told
    assert ("a", "2", False) in told and ("b", "x", False) in told and ("c", "y", False) not in told and ("d", "w", True) in told


def test_repositories(spark, tmp_path):  # noqa: ANN001
    import subprocess

    import pytest

    from codequarry.sources import repositories as r

    assert r.url_parts(spark, "https://github.com/a/b.git") == ("github.com", "a", "b") and r.url_parts(spark, "/tmp/x") is None
    assert r.is_url(spark, "gitlab.com/x/y") and r.is_url(spark, "http://z") and not r.is_url(spark, "folder") and r.clone_url("h", "o", "p") == "https://h/o/p.git"
    one = tmp_path / "one"
    one.mkdir()
    (one / "f.txt").write_text("x" * 2048)
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=n", "-c", "user.email=e", "commit", "-qm", "m"]):
        subprocess.run(["git", *args], cwd=one, check=True)
    copy = r.fetch(f"file://{one}", tmp_path / "copy")
    assert (copy / "f.txt").exists()
    (copy / "mark").write_text("")
    assert (r.fetch(f"file://{one}", copy) / "mark").exists() and not (r.fetch(f"file://{one}", copy, force=True) / "mark").exists()
    with pytest.raises(ValueError, match="MB"):
        r.fetch(f"file://{one}", tmp_path / "large", megabytes=0)
    with pytest.raises(RuntimeError, match="failed"):
        r.fetch(f"file://{tmp_path}/none", tmp_path / "none2")
    assert abs(r.repository_size(spark.createDataFrame([(1 << 20,), (1 << 19,)], "size long")).first().megabytes - 1.5) < 1e-9


def test_pages_and_references(spark):  # noqa: ANN001
    from codequarry.operators import pages, patterns, prompts

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    row = lambda text, schema: F.from_json(F.lit(text), schema)
    arch = '{"architecture_type": "layered", "components": [{"name": "Core Part", "purpose": "p", "files": ["a.py", "b.py"]}], "mermaid_component": "graph", "data_flow": "down"}'
    text = one(pages.architecture_page(row(arch, pages.ARCHITECTURE), "en"))
    assert text.startswith(
        "# Architecture\n\n<cite>\n\n**Files Referenced**\n\n- [a.py](file://a.py)\n- [b.py](file://b.py)\n</cite>\n\n**Type:** layered\n"
    ) and "## Component Diagram\n\n```mermaid\ngraph\n```\n" in text and "Files: `a.py`, `b.py`\n" in text and text.endswith("## Data Flow\n\ndown\n")
    both = one(pages.architecture_page(row(arch.replace('"data_flow"', '"mermaid_sequence": "seq", "data_flow"'), pages.ARCHITECTURE)))
    assert '    Core_Part["Core Part"]' in both and "Sequence Diagram" not in both
    guide = one(
        pages.guide_page(
            row(
                '{"introduction": "hi", "steps": [{"order": 1, "title": "Start", "time_estimate": "5m", "files": ["m.py"]}], "tips": ["t"]}',
                pages.GUIDE
            ),
            "en"
        )
    )
    assert "## Step 1: Start (~5m)\n\n**Files:** `m.py`\n\n**Section Source**\n\n- [m.py](file://m.py)\n" in guide and guide.endswith("## Tips\n\n- t\n")
    files = row(
        '[{"path": "cfg", "is_config": true, "is_entrypoint": false}, {"path": "plain", "is_config": false, "is_entrypoint": false}]',
        "array<struct<path:string,is_config:boolean,is_entrypoint:boolean>>"
    )
    view = one(
        pages.overview_page(
            row(
                '{"name": "N", "one_liner": "o", "entry_points": ["e.py"], "tech_stack": [{"name": "T", "version": "1", "category": ""}], "setup_instructions": ["do"]}',
                pages.OVERVIEW
            ),
            files
        )
    )
    assert "- [e.py](file://e.py)\n- [cfg](file://cfg)\n</cite>" in view and "1. [入口点](#入口点)\n2. [技术栈](#技术栈)\n3. [快速开始](#快速开始)" in view and "- **T** 1\n" in view and "1. do" in view and "plain" not in view
    content = "# T\n## One\ntext\n```mermaid\ngraph\n```\n\n## Two\n\n**Section Source**\n- x"
    put = one(pages.with_references(F.lit(content), F.array(F.lit("f.py")), "en"))
    assert put == "# T\n## One\n\n**Section Source**\n- [f.py](file://f.py)\n\ntext\n```mermaid\n\n**Diagram Source**\n- [f.py](file://f.py)\n\ngraph\n```\n\n## Two\n\n**Section Source**\n- x"
    assert one(pages.with_references(F.lit(content), F.array().cast("array<string>"))) == content
    shown = one(prompts.files_context(F.array(F.struct(F.lit("a.py").alias("path"), F.lit("python").alias("language"), F.lit("x" * 9).alias("content"))), 5))
    assert shown == "### a.py\n```python\nxxxxx\n... (truncated)\n```" and one(prompts.referenced(F.lit(shown))) == ["a.py"]
    for built in (
        prompts.overview(F.lit("t"), F.lit("k")), prompts.architecture(F.lit("t"), F.lit("d"), F.lit("s")),
        prompts.reading_guide(F.lit("t"), F.lit("c"), F.lit("s"), "zh"), prompts.chat(F.lit("q"), F.lit(None).cast("string")),
        prompts.exploration(F.lit("m"), F.lit("p"), F.lit("s"), F.lit("c"))
    ):
        assert one(built).startswith("## Task\n")
    index_prompt = one(prompts.category_index(F.lit("C"), F.lit("d"), F.array(F.struct(F.lit("A").alias("title"), F.lit("why").alias("purpose"))), "xx"))
    assert "- **A**: why" in index_prompt and index_prompt.endswith("Respond in English.")
    assert one(
        prompts.structure_summary(
            F.lit("tree"), F.array(F.struct(F.lit("a").alias("src_module"), F.array(F.lit("c"), F.lit("b")).alias("targets"))),
            F.array(F.lit("m.py"))
        )
    ) == "File tree:\ntree\n\n## Module Dependencies\n- a → b, c\n\n## Top Files by Importance (PageRank)\n- m.py"
    names = spark.createDataFrame([(f"f.py:{n}:{i}", n) for i, n in enumerate(("UserFactory", "make_it", "create", "OrderModel", "view"))], "id string, name string")
    drawn = patterns.pattern_diagram(patterns.recognise(names)).first().diagram.split("\n")
    assert drawn[0] == "graph TD" and drawn[1] == "    P0[(FACTORY)]" and "    P0_0[(UserFactory)]" in drawn and "    P0_0 --> P0" in drawn and drawn[-1].startswith("    classDef REPOSITORY")
    assert patterns.pattern_diagram(patterns.recognise(names.limit(1))).first().diagram == ""


def test_exploration(spark):  # noqa: ANN001
    from codequarry.operators import generation

    def client(prompt: str) -> str:
        return '{"name": "m"}' if "secret body" in prompt else "## Files I Need\n- src/a.py\n- src/none.py\n" if "ask" in prompt else "never" * 3

    files = spark.createDataFrame([("src/a.py", "secret body", 5), ("src/FooDto.java", "x", 9)], "path string, content string, size int")
    got = {
        r.id: (r.answer, r.turns) for r in generation.explore(
            spark.createDataFrame([("m", "ask"), ("n", "tell")], "id string, prompt string"), files, client
        ).collect()
    }
    assert got == {"m": ('{"name": "m"}', 2), "n": ("never" * 3, 1)}
    assert rows(generation.chosen_files(files), "path") == [("src/a.py",)]


def test_default_map_and_lookups(spark):  # noqa: ANN001
    categories, docs = docmap.default_map(spark.createDataFrame([("big_one", 9), ("api", 2)], "module string, n_files int"))
    assert rows(categories, "ord", "id", "title") == [(1, "big-one", "Big One"), (2, "api", "Api")]
    assert rows(docs, "category_id", "patterns") == [("api", ["api/*"]), ("big-one", ["big_one/*"])]
    assert docmap.doc(docs, "api/overview").count() == docmap.category(categories, "api").count() == docmap.docs_in(docs, "api").count() == 1 and docmap.child_categories(categories, "api").count() == 0
    chinese = docmap.in_chinese(categories, docs)
    assert rows(chinese[0], "id") == [("API参考",), ("big-one",)] and rows(docmap.in_chinese(*chinese)[0], "id") == rows(chinese[0], "id")


def test_globs(spark):  # noqa: ANN001
    import fnmatch

    paths = ["a.py", "src/a.py", "src/b/c.py", "src/b/c.txt", "/abs/x.py", "src/[x]/y.py", "lib/a.py", "src", "src/b/"]
    globs = ["*.py", "src/*", "src/b/*.py", "src/b/c.py", "s?c/a.py", "/abs/*", "src/[[]x]/*", "src/[!b]*", "lib/", "src", "*/b/*", "src/b/", "", "src/[x*", "*[[]*"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    docs = spark.createDataFrame([(g, [g]) for g in globs] + [("two", ["lib/*", "lib/a*"])], "doc_id string, patterns array<string>")
    want = {(g, p) for g in globs for p in paths if fnmatch.fnmatchcase(p, g)} | {("two", "lib/a.py")}
    assert rows(docmap.matching_files(files, docs), "doc_id", "path") == sorted(want)


@pytest.mark.parametrize("most_short", [0, 100_000])
def test_globs_by_windows(spark, monkeypatch, most_short):  # noqa: ANN001
    """However many globs there are, as many passes over the paths are made: an automaton for each 64 bytes of them was one more pass."""
    import fnmatch

    from codequarry.functions import automaton

    monkeypatch.setattr(automaton, "STATES", 64)
    monkeypatch.setattr(docmap, "MOST_SHORT", most_short, raising=False)
    monkeypatch.setattr(docmap, "A_TASK", 50, raising=False)
    paths = [f"src{i % 3}/é𝄞{i % 5}/doc_{i}.txt" for i in range(120)] + ["aaaa", "aaaaaaaa", "ab" * 40 + "c", "ab" * 40 + "cd", "𝄞", "a"]
    globs = [*(f"*/doc_{i}.txt" for i in range(0, 130, 2)), *(f"*doc_{i}?.*" for i in range(15)), *(f"?rc[0-1]*{i}.t[xy]t" for i in range(9))]
    globs += ["*é𝄞3/*", "𝄞", "*aaa*", "a*aaaaa", "*" + "ab" * 40 + "c", "*" + "ab" * 33 + "d", "*ba*b*c*", "*zz*doc_*", "?", "*", "??", "*/doc_1*/*"]
    files = spark.createDataFrame([(p,) for p in paths] * 2 + [(None,)], "path string")
    made = lambda some: docmap.matching_files(files, spark.createDataFrame([(g, [g]) for g in some], "doc_id string, patterns array<string>"))
    want = sorted((g, p) for g in globs for p in paths if fnmatch.fnmatchcase(p, g))
    assert rows(many := made(globs), "doc_id", "path") == want and rows(made([]), "path") == []
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves(many) == leaves(made(globs[:3]))


def test_paths(spark):  # noqa: ANN001
    got = {
        r.path: r for r in spark.createDataFrame(
            [(p,) for p in ("Dockerfile", "a/Makefile", "x.PY", "noext", ".env")], "path string"
        ).select("path", f.language(F.col("path")).alias("l")).collect()
    }
    assert [got[p].l for p in ("Dockerfile", "a/Makefile", "x.PY", "noext")] == ["dockerfile", "makefile", "python", "unknown"]
    tree = docmap.file_tree(spark.createDataFrame([("a/b.py",), ("a/c/d.py",), ("e.py",)], "path string"), most=3).orderBy("line_no").collect()
    assert [r.line for r in tree] == ["a/", "  b.py", "  c/", "... and 2 more entries"]
    html = spark.createDataFrame([("```\n<a>\n```\n# T",)], "t string").select(render.markdown_to_html(F.col("t")).alias("h")).first().h
    assert html == '<pre><code class="language-text">&lt;a&gt;</code></pre>\n<h1>T</h1>'


def test_generation(spark):  # noqa: ANN001
    from codequarry.operators import generation

    calls = []

    def flaky(prompt: str) -> str:
        if "bad" in prompt:
            raise RuntimeError("no")
        return 'text ```json\n{"title": "T", "n": 1, "other": 2}\n``` end'

    got = {r.id: r for r in generation.complete(spark.createDataFrame([("a", "ok"), ("b", "bad")], "id string, prompt string"), flaky, pause=0).collect()}
    assert (got["a"].status, got["b"].status, got["b"].answer) == ("success", "failed", None) and not calls
    answers = spark.createDataFrame([("a", got["a"].answer), ("b", "none"), ("c", "see [1, {\"title\": 3}] {\"title\": \"x\"}")], "id string, answer string")
    read = {r.id: r.title for r in generation.json_answers(answers, "title string, n int").collect()}
    assert read["a"] == "T" and read["b"] is None
    text = "I'd like more.\n## Files I Need\n- src/a.py\n* **lib\\b.ts**\n- not a path\n## Next\nplease show me the content of cmd/main.go and x.txt; also web/app.vue here"
    assert spark.range(1).select(generation.requested_files(F.lit(text)).alias("p")).first().p == ["src/a.py", "lib/b.ts", "cmd/main.go", "web/app.vue"]
    files = spark.createDataFrame(
        [("src/x.py", "python", "def a(b):\n  pass\nclass C:\n  pass", False), ("package.json", "json", "{}", True)],
        "path string, language string, content string, is_config boolean"
    )
    assert generation.project_type(files).first().project_type == "full-stack"
    assert rows(generation.signatures(files), "path", "signatures") == [("src/x.py", ["def a(b)", "class C"])]


def project_folder(tmp_path):  # noqa: ANN001, ANN201
    for name, content in {
        "main.py": "import lib.util\nclass Factory:\n    pass\ndef create():\n    pass\n", "lib/util.py": "import lib.other\nx = 1\n",
        "lib/other.py": "y = 2\n"
    }.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return str(tmp_path / "in")


def test_wiki(spark, tmp_path):  # noqa: ANN001
    from codequarry.plans import wiki
    from codequarry.sources import sinks

    root, out, steps = project_folder(tmp_path), tmp_path / "out", []
    record = wiki.build(spark, root, str(out), "Demo", on_progress=steps.append)
    assert rows(record, "id") == [("architecture",), ("dependencies",), ("docs/lib/overview",), ("docs/root/overview",), ("index",)]
    assert "root --> lib" in (out / "content/dependencies.md").read_text() and "FACTORY" in (out / "content/architecture.md").read_text()
    bar = (out / "_sidebar.md").read_text().split("\n")
    assert bar[0] == "# Demo" and bar[2:] == [
        "- [Overview](content/index.md)", "- **Lib**", "  - [Lib](content/docs/lib/overview.md)", "- **Root**",
        "  - [Root](content/docs/root/overview.md)", "- [Architecture](content/architecture.md)",
        "- [Dependencies](content/dependencies.md)", ""
    ]
    back = sinks.read_metadata(spark, str(out))
    assert rows(back["catalogs"], "name") == [("Lib",), ("Root",)] and back["items"].count() == 2 and rows(back["relations"], "id") == [(1,), (2,)]
    assert steps[0] == "scanning" and steps[-1] == "done"
    done = spark.createDataFrame([("lib/overview", "success")], "doc_id string, status string")
    tables = wiki.analyse(spark, root)
    docs = wiki.document_map(tables)[1]
    asked = []
    again = wiki.generate_documents(tables, docs, lambda p: asked.append(p) or "text", done)
    assert rows(again, "doc_id") == [("root/overview",)]
    cache = wiki.document_prompts(tables, docs).select("memo", F.lit("kept").alias("answer"))
    assert rows(wiki.generate_documents(tables, docs, cache=cache), "doc_id", "content") == [("lib/overview", "kept"), ("root/overview", "kept")]
    pages, entries = wiki.from_modules(tables, wiki.legacy_modules(tables))
    assert rows(pages, "id") == [
        ("dependencies",), ("index",), ("modules/lib",), ("modules/root",)
    ] and "  - [lib](content/modules/lib.md)" in render.sidebar(entries).first().text


def test_project(spark, tmp_path):  # noqa: ANN001
    from codequarry.plans.project import Project, Projects, doc_page

    known = Projects()
    project = Project(spark, project_folder(tmp_path), client=lambda p: "said " + str(len(p)))
    key = known.add(project)
    assert known.get(key) is project and known.get("none") is None and project.info().first().status == "pending"
    project.scan()
    assert project.status == "done", project.message
    assert project.info().first().n_files == 3 and known.table(spark).first().status == "done"
    events, n, over = project.events_since(0)
    assert over and n == len(events) and events[-1] == ("done", "done")
    assert rows(project.file("lib/util.py"), "language", "lines") == [("python", 3)] and project.file("no").count() == 0
    assert project.page("index").count() == 1 and rows(project.wiki()[0], "id")[0] == ("dependencies",)
    graph_ = project.graph()
    assert rows(graph_["edges"], "src", "dst") == [("lib/util.py", "lib/other.py"), ("main.py", "lib/util.py")] and graph_["rankings"].count() == 3
    assert rows(project.search("UTIL"), "path") == [("lib/util.py",)] and project.ask("where is Factory?").first().status == "success"
    written = rows(project.pages.where("id like 'docs/%'"), "id")
    docs = spark.createDataFrame([(written[0][0].removeprefix("docs/"), "c"), ("none", "c")], "id string, category_id string")
    assert rows(doc_page(project, docs, docs.first().id), "id") == written[:1] and doc_page(project, docs, "none").count() == 0
    failed = Project(spark, str(tmp_path / "none")).scan()
    assert failed.status == "error" and failed.message


def test_command_line(tmp_path, monkeypatch):  # noqa: ANN001
    from codequarry.__main__ import configure

    monkeypatch.chdir(tmp_path)
    assert configure("set", "api_key", "0123456789") == ["api_key is set"] and configure("get", "api_key", None) == ["api_key = 0123...6789"]
    assert configure("set", "max_files", "7") and "max_files = 7" in configure("list", None, None) and configure("get", "nope", None) == ["unknown setting: nope"]


def test_config(tmp_path, monkeypatch):  # noqa: ANN001
    from codequarry.config import Config

    Config(model="short", max_files=7).save(str(tmp_path))
    monkeypatch.setenv("CODEQUARRY_LANGUAGE", "zh")
    got = Config.load(str(tmp_path), {"short": "long/name"})
    assert (got.model, got.max_files, got.language) == ("long/name", 7, "zh")

"""Pages of a wiki as text columns: each renderer takes a struct column and gives Markdown. Lines that have nothing to say are null and
drop out of the join. The structs are declared as schemas, in which answers of a client are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERVIEW = (
    "name string, one_liner string, description string, project_type string, entry_points array<string>, tech_stack array<struct<name:string,version:string,category:string>>, "
    "key_features array<string>, setup_instructions array<string>"
)
ARCHITECTURE = (
    "architecture_type string, description string, components array<struct<name:string,purpose:string,files:array<string>>>, "
    "mermaid_component string, mermaid_sequence string, data_flow string"
)
MODULE = (
    "name string, purpose string, description string, files array<struct<path:string,purpose:string,key_symbols:array<struct<name:string,kind:string,line:int,description:string>>>>, "
    "relationships array<struct<source:string,target:string,description:string>>, key_concepts array<struct<name:string,explanation:string>>"
)
GUIDE = "introduction string, steps array<struct<order:int,title:string,time_estimate:string,files:array<string>,explanation:string>>, tips array<string>"

# Labels that pages carry, by language; an unknown language has the English ones.
LABELS = {
    "en": {"cited": "Files Referenced", "toc": "Table of Contents", "diagram": "Diagram Source", "section": "Section Source", "respond": "Respond in English."},
    "zh": {"cited": "本文引用的文件", "toc": "目录", "diagram": "图表来源", "section": "章节来源", "respond": "请用中文回答。"},
}


def labels(language: str) -> dict[str, str]:
    return LABELS.get(language, LABELS["en"])


def given(text: Column) -> Column:
    """text, or null if it is empty."""
    return F.when(F.length(text) > 0, text)


def listed(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def some(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def lines(values: Column, line: Callable[[Column], Column]) -> Column:
    """A line for each value, joined."""
    return F.array_join(F.transform(values, line), "\n")


def block(when: Column, *parts: Column | str) -> Column:
    """Parts under each other, or null; null parts drop out."""
    return F.when(when, F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts)))


def linked(path: Column) -> Column:
    return F.concat(F.lit("- ["), path, F.lit("](file://"), path, F.lit(")"))


def _numbered(values: Column, line: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(values, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), line(x))), "\n")


def cited(paths: Column, most: int, label: str) -> Column:
    """The block of files that a page rests on; null without any."""
    return block(some(paths), "<cite>\n", f"**{label}**\n", lines(F.slice(paths, 1, most), linked), "</cite>\n")


def key_files(entry_points: Column, files: Column) -> Column:
    """Paths cited by the overview: five entry points, then configuration and entry files among the first twenty of files (path,
    is_config, is_entrypoint), fifteen in all."""
    marked = F.transform(F.filter(F.slice(files, 1, 20), lambda f: f["is_entrypoint"] | f["is_config"]), lambda f: f["path"])
    return F.slice(F.array_distinct(F.concat(F.slice(listed(entry_points), 1, 5), marked)), 1, 15)


def overview_page(o: Column, files: Column, language: str = "zh") -> Column:
    words = labels(language)
    # Entries of the contents.
    contents = (
        ("项目类型", given(o["project_type"]).isNotNull()), ("入口点", some(o["entry_points"])), ("技术栈", some(o["tech_stack"])),
        ("主要特性", some(o["key_features"])), ("快速开始", some(o["setup_instructions"]))
    )
    toc = F.filter(F.array(*(F.when(shown, F.lit(name)) for name, shown in contents)), lambda x: x.isNotNull())
    tech = lambda t: F.concat(
        F.lit("- **"), t["name"], F.lit("**"), F.coalesce(F.concat(F.lit(" "), given(t["version"])), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), given(t["category"]), F.lit(")")), F.lit(""))
    )
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), o["name"], F.lit("\n")), cited(key_files(o["entry_points"], files), 15, words["cited"]),
        F.concat(F.lit("> "), given(o["one_liner"]), F.lit("\n")), F.concat(given(o["description"]), F.lit("\n")), F.lit(f"## {words['toc']}\n"),
        given(_numbered(toc, lambda x: F.concat(F.lit("["), x, F.lit("](#"), x, F.lit(")")))), F.lit(""),
        F.concat(F.lit("**Project Type:** "), given(o["project_type"]), F.lit("\n")),
        F.when(
            some(o["entry_points"]),
            F.concat(
                F.lit("**Entry Points:** "),
                F.array_join(F.transform(o["entry_points"], lambda e: F.concat(F.lit("`"), e, F.lit("`"))), ", "), F.lit("\n")
            )
        ),
        block(some(o["tech_stack"]), "\n## Tech Stack\n", lines(o["tech_stack"], tech), ""),
        block(some(o["key_features"]), "\n## Key Features\n", lines(o["key_features"], lambda x: F.concat(F.lit("- "), x)), ""),
        block(some(o["setup_instructions"]), "\n## Getting Started\n", _numbered(o["setup_instructions"], lambda x: x), ""),
    )


def _component(c: Column) -> Column:
    files = F.array_join(F.transform(c["files"], lambda f: F.concat(F.lit("`"), f, F.lit("`"))), ", ")
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), c["name"], F.lit("\n")), F.concat(given(c["purpose"]), F.lit("\n")),
        F.when(some(c["files"]), F.concat(F.lit("Files: "), files, F.lit("\n")))
    )


def combined_diagrams(a: Column) -> Column:
    """The components as boxes of one diagram, then each with its purpose and files."""
    box = lambda c: F.concat(F.lit("    "), F.translate(c["name"], " ", "_"), F.lit('["'), c["name"], F.lit('"]'))
    return F.concat_ws(
        "\n", F.lit("## Combined Architecture\n"), F.lit("```mermaid\n"), F.lit("flowchart TB\n"), given(lines(a["components"], box)),
        F.lit("```\n"), block(some(a["components"]), "## Components\n", lines(a["components"], _component))
    )


def architecture_page(a: Column, language: str = "zh") -> Column:
    words = labels(language)
    files = F.array_distinct(
        F.flatten(
            F.transform(
                F.coalesce(
                    a["components"], F.array().cast("array<struct<name:string,purpose:string,files:array<string>>>")
                ), lambda c: listed(c["files"])
            )
        )
    )
    sources = block(some(files), f"**{words['diagram']}**\n", lines(F.slice(files, 1, 5), linked), "")
    drawn = lambda title, c: block(given(c).isNotNull(), f"## {title}\n", F.concat(F.lit("```mermaid\n"), c, F.lit("\n```\n")), sources)
    both = given(a["mermaid_component"]).isNotNull() & given(a["mermaid_sequence"]).isNotNull()
    apart = F.concat_ws(
        "\n", drawn("Component Diagram", a["mermaid_component"]),
        block(some(a["components"]), "## Components\n", lines(a["components"], _component)),
        drawn("Sequence Diagram", a["mermaid_sequence"])
    )
    return F.concat_ws(
        "\n", F.lit("# Architecture\n"), cited(files, 15, words["cited"]), F.concat(
            F.lit("**Type:** "), given(a["architecture_type"]), F.lit("\n")
        ), F.concat(given(a["description"]), F.lit("\n")),
        given(F.when(both, combined_diagrams(a)).otherwise(apart)), block(given(a["data_flow"]).isNotNull(), "## Data Flow\n", F.concat(a["data_flow"], F.lit("\n"))),
    )


def module_page(m: Column, language: str = "zh") -> Column:
    words = labels(language)
    none = F.array().cast("array<struct<name:string,kind:string,line:int,description:string>>")

    def told(s: Column) -> Column:
        line = F.when(s["line"] > 0, F.concat(F.lit(" (line "), s["line"].cast("string"), F.lit(")"))).otherwise("")
        return F.concat(F.lit("- `"), s["name"], F.lit("` ("), s["kind"], F.lit(")"), line, F.coalesce(F.concat(F.lit(" — "), given(s["description"])), F.lit("")))

    def file(f: Column) -> Column:
        return F.concat_ws(
            "\n", F.concat(F.lit("### `"), f["path"], F.lit("`\n")), F.concat(given(f["purpose"]), F.lit("\n")),
            block(some(f["key_symbols"]), "**Key Symbols:**\n", lines(f["key_symbols"], told), "")
        )

    def references(f: Column) -> Column:
        at = lambda n: F.when(
            n > 0,
            F.concat(
                F.lit("- ["), f["path"], F.lit(":"), n.cast("string"), F.lit("-"), n.cast("string"), F.lit("](file://"), f["path"],
                F.lit("#"), n.cast("string"), F.lit("-"), n.cast("string"), F.lit(")")
            )
        ).otherwise(linked(f["path"]))
        return F.when(
            some(f["key_symbols"]), F.transform(F.coalesce(f["key_symbols"], none), lambda s: at(F.coalesce(s["line"], F.lit(0))))
        ).otherwise(F.array(linked(f["path"])))

    refs = F.array_distinct(F.flatten(F.transform(F.slice(m["files"], 1, 10), references)))
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), m["name"], F.lit("\n")), cited(
            F.transform(m["files"], lambda f: f["path"]), 10, words["cited"]
        ), F.concat(F.lit("> "), given(m["purpose"]), F.lit("\n")),
        F.concat(given(m["description"]), F.lit("\n")), block(some(m["files"]), "## Files\n", lines(m["files"], file), F.array_join(refs, "\n"), ""),
        block(some(m["key_concepts"]), "## Key Concepts\n", lines(m["key_concepts"], lambda c: F.concat(F.lit("- **"), c["name"], F.lit("**: "), c["explanation"])), ""),
        block(
            some(m["relationships"]), "## Internal Relationships\n",
            lines(
                m["relationships"], lambda r: F.concat(
                    F.lit("- `"), r["source"], F.lit("` → `"), r["target"], F.lit("`: "), r["description"]
                )
            ),
            ""
        ),
    )


def guide_page(g: Column, language: str = "zh") -> Column:
    words = labels(language)

    def step(s: Column) -> Column:
        time = F.coalesce(F.concat(F.lit(" (~"), given(s["time_estimate"]), F.lit(")")), F.lit(""))
        files = F.array_join(F.transform(s["files"], lambda f: F.concat(F.lit("`"), f, F.lit("`"))), ", ")
        return F.concat_ws(
            "\n", F.concat(
                F.lit("## Step "), s["order"].cast("string"), F.lit(": "), s["title"], time, F.lit("\n")
            ), F.when(some(s["files"]), F.concat(F.lit("**Files:** "), files, F.lit("\n"))),
            F.concat(given(s["explanation"]), F.lit("\n")), block(some(s["files"]), f"**{words['section']}**\n", lines(s["files"], linked), ""),
        )

    return F.concat_ws(
        "\n", F.lit("# Reading Guide\n"), F.concat(given(g["introduction"]), F.lit("\n")), given(lines(g["steps"], step)),
        block(some(g["tips"]), "## Tips\n", lines(g["tips"], lambda t: F.concat(F.lit("- "), t)), ""),
    )


def dependency_page(diagram: Column, core: Column, entries: Column) -> Column:
    """diagram, the core files in order (array), and entry points (array), of which ten are shown."""
    ticked = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    return F.concat_ws(
        "\n", F.lit("# Module Dependencies\n"), F.concat(F.lit("```mermaid\n"), diagram, F.lit("\n```\n")),
        block(some(core), "## Core Files (by PageRank)\n", _numbered(core, ticked), ""),
        block(some(entries), "## Likely Entry Points\n", lines(F.slice(entries, 1, 10), lambda e: F.concat(F.lit("- "), ticked(e))), ""),
    )


def category_page(category: Column, docs: Column, language: str = "zh") -> Column:
    """Index of a category(title, description) with docs(id, title, purpose, done) in order. Its headings."""
    entry = lambda d: F.concat(
        F.lit("- ["), F.when(d["done"], "✓").otherwise("○"), F.lit("] ["), d["title"], F.lit("](docs/"), d["id"], F.lit(") — "),
        F.coalesce(d["purpose"], F.lit(""))
    )
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), category["title"], F.lit("\n")), F.concat(given(category["description"]), F.lit("\n\n")), F.lit("<cite>\n"), F.concat(
            F.lit("**分类文档: "), category["title"], F.lit("**\n")
        ),
        F.concat(F.lit("- 包含 "), F.size(docs).cast("string"), F.lit(" 个文档\n")), F.lit("</cite>\n"), F.lit(f"## {labels(language)['toc']}\n"),
        _numbered(docs, lambda d: F.concat(F.lit("["), d["title"], F.lit("](#"), d["id"], F.lit(")"))), F.lit(""), F.lit("## 文档列表\n"), lines(docs, entry),
    )


def with_references(content: Column, files: Column, language: str = "zh") -> Column:
    """content with a source line put in behind every section heading and opening of a diagram that no source follows: one fold over
    the lines, each of which sees the next filled line behind it, or for a diagram behind its end."""
    words = labels(language)
    text = F.split(content, "\n", -1)
    filled = lambda rest: F.coalesce(F.try_element_at(F.filter(rest, lambda x: ~x.rlike(r"^\s*$")), F.lit(1)), F.lit(""))
    after = lambda i: F.slice(text, i + 2, F.greatest(F.size(text) - i - 1, F.lit(0)))

    def end(rest: Column) -> Column:
        close = F.array_position(F.transform(rest, lambda x: x.rlike(r"^\s*```")), True).cast("int")
        return F.when(close > 0, F.slice(rest, close + 1, F.size(rest))).otherwise(F.array().cast("array<string>"))

    said = lambda line, *names: F.exists(F.array(*(F.lit(f"**{words[n]}**") for n in names)), lambda w: F.contains(line, w))
    source = F.concat(F.lit("- ["), F.get(files, F.lit(0)), F.lit("](file://"), F.get(files, F.lit(0)), F.lit(")"))
    put = lambda name: F.array(F.lit(""), F.lit(f"**{words[name]}**"), source, F.lit(""))
    none = F.array().cast("array<string>")

    def line(x: Column, i: Column) -> Column:
        diagram = F.when((F.trim(x) == "```mermaid") & ~said(filled(end(after(i))), "diagram", "section"), put("diagram")).otherwise(none)
        section = F.when(x.rlike(r"^#{2,3}\s+.+") & ~said(filled(after(i)), "section"), put("section")).otherwise(none)
        return F.concat(F.array(x), diagram, section)

    return F.when((F.length(content) > 0) & some(files), F.array_join(F.flatten(F.transform(text, line)), "\n")).otherwise(content)

"""Rendering of tables as text: Markdown to HTML, diagrams, sidebars, wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.files import diagram_id, module_name

UI_WORDS = ("components", "pages", "views", "ui", "frontend", "client", "web")


def escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def inline_html(text: Column) -> Column:
    text = F.regexp_replace(escaped(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    text = F.regexp_replace(text, r"`(.+?)`", "<code>$1</code>")
    return F.regexp_replace(text, r"\[(.+?)\]\((.+?)\)", '<a href="$2">$1</a>')


def markdown_to_html(text: Column) -> Column:
    """A small Markdown: headings, quotes, items, fenced code and diagrams, bold, code and links. One fold over the lines, whose
    state is whether a fence is open, its language and its lines. A fence that stays open renders nothing."""

    def tag(line: Column) -> Column:
        out = F.concat(F.lit("<p>"), inline_html(line), F.lit("</p>"))
        rules = ((r"^\d+\. ", "li"), (r"^- ", "li"), (r"^> ", "blockquote"), (r"^### ", "h3"), (r"^## ", "h2"), (r"^# ", "h1"))
        out = F.when(line.rlike(r"^\s*$"), F.lit("<br>")).otherwise(out)
        for pattern, name in rules:
            out = F.when(line.rlike(pattern), F.concat(F.lit(f"<{name}>"), inline_html(F.regexp_replace(line, pattern, "")), F.lit(f"</{name}>"))).otherwise(out)
        return out

    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("lang"), F.array().cast("array<string>").alias("code"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        fence = line.startswith("```")
        lang = F.regexp_replace(F.regexp_replace(line, "^```", ""), r"^\s+|\s+$", "")
        code = escaped(F.array_join(s["code"], "\n"))
        block = F.when(s["lang"] == "mermaid", F.concat(F.lit('<div class="mermaid">'), code, F.lit("</div>"))).otherwise(
            F.concat(F.lit('<pre><code class="language-'), s["lang"], F.lit('">'), code, F.lit("</code></pre>"))
        )
        return (
            F.when(
                fence & s["open"],
                F.struct(
                    F.lit(False).alias("open"), F.lit("").alias("lang"), F.array().cast("array<string>").alias("code"),
                    F.array_append(s["out"], block).alias("out")
                )
            )
            .when(
                fence,
                F.struct(
                    F.lit(True).alias("open"), F.when(lang == "", "text").otherwise(lang).alias("lang"),
                    F.array().cast("array<string>").alias("code"), s["out"].alias("out")
                )
            )
            .when(s["open"], F.struct(s["open"].alias("open"), s["lang"].alias("lang"), F.array_append(s["code"], line).alias("code"), s["out"].alias("out")))
            .otherwise(F.struct(s["open"].alias("open"), s["lang"].alias("lang"), s["code"].alias("code"), F.array_append(s["out"], tag(line)).alias("out")))
        )

    return F.array_join(F.aggregate(F.split(text, "\n"), start, step, lambda s: s["out"]), "\n")


def edge_lines(edges: DataFrame) -> DataFrame:
    """line of a diagram for every distinct edge of edges(src, dst)."""
    return edges.select("src", "dst").distinct().select(
        "src", "dst", F.concat(F.lit("  "), diagram_id(F.col("src")), F.lit(" --> "), diagram_id(F.col("dst"))).alias("line")
    )


def module_diagram(files: DataFrame, dependencies: DataFrame, most: int = 12) -> DataFrame:
    """diagram: one row of text for files(path) and dependencies(src_module, dst_module): user-interface and other modules apart where
    there are both, else the largest modules; then the edges in order. Modules and edges between them are few."""
    sizes = files.groupBy(module_name(F.col("path")).alias("module")).agg(F.count("*").alias("n"))
    sources = dependencies.select(F.col("src_module").alias("module")).distinct().join(sizes, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("n"))
    front = F.exists(F.array(*(F.lit(w) for w in UI_WORDS)), lambda w: F.contains(F.lower("module"), w))
    box = lambda pad: F.concat(
        F.lit(pad), diagram_id(F.col("module")), F.lit("[("), F.col("module"), F.lit(" - "), F.col("n").cast("string"), F.lit(" files)]")
    )
    split = sources.select("module", front.alias("front"), box("    ").alias("line")).agg(
        F.sort_array(F.collect_list(F.when(F.col("front"), F.struct("module", "line")))).alias("f"), F.sort_array(
            F.collect_list(F.when(~F.col("front"), F.struct("module", "line")))
        ).alias("b")
    )
    plain = sizes.orderBy(F.col("n").desc(), "module").limit(most).select(F.col("n"), F.col("module"), box("  ").alias("line")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "module", "line"))).alias("p")
    )
    edges = edge_lines(
        dependencies.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))
    ).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "line"))).alias("e"))
    text = lambda c: F.transform(c, lambda x: x["line"])
    both = (F.size("f") > 0) & (F.size("b") > 0)
    parts = F.when(
        both,
        F.concat(F.array(F.lit("  subgraph Frontend")), text("f"), F.array(F.lit("  end"), F.lit("  subgraph Backend")), text("b"), F.array(F.lit("  end"), F.lit(""))),
    ).otherwise(text("p"))
    body = F.concat(F.array(F.lit("graph TD")), parts, F.array(F.lit("")), text("e"))
    return split.crossJoin(plain).crossJoin(edges).select(F.when(F.size("e") > 0, F.array_join(body, "\n")).otherwise("").alias("diagram"))


def sidebar(items: DataFrame) -> DataFrame:
    """text: one row for items(sort_path, depth, title, page_id), nested by depth in the order of sort_path; slashes stay slashes."""
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth")),
        F.when(
            F.col("page_id") != "", F.concat(F.lit("- ["), "title", F.lit("](content/"), "page_id", F.lit(".md)"))
        ).otherwise(F.concat(F.lit("- **"), "title", F.lit("**")))
    )
    return items.agg(
        F.sort_array(F.collect_list(F.struct("sort_path", line.alias("line")))).alias("a")
    ).select(F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


def category_pages(categories: DataFrame, docs: DataFrame, least: int = 3) -> DataFrame:
    """category_id, title, n_docs, content: an index page for every category with at least `least` of docs(id, title, category_id, purpose, ord)."""
    order = Window.partitionBy("category_id").orderBy("ord", "id")
    numbered = docs.withColumn("no", F.row_number().over(order))
    line = F.concat(F.col("no").cast("string"), F.lit(". **"), F.col("title"), F.lit("**: "), F.col("purpose"))
    lists = numbered.groupBy("category_id").agg(
        F.count("*").alias("n_docs"), F.sort_array(F.collect_list(F.struct("no", line.alias("line")))).alias("a")
    ).where(F.col("n_docs") >= least)
    named = categories.select(F.col("id").alias("category_id"), F.col("title"))
    return lists.join(named, "category_id").select(
        "category_id", "title", "n_docs",
        F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("content")
    )


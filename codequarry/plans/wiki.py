"""The whole way from a folder to a wiki: scan, imports, graph, generated texts, pages, files."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.config import Config
from codequarry.functions.files import module_name
from codequarry.operators import docmap, generation, graph, imports, index, metadata, patterns, prompts, render, state, symbols
from codequarry.operators import pages as render_pages
from codequarry.session import durable
from codequarry.sources import sinks
from codequarry.sources.files import project_name, scan_directory

Progress = Callable[[str], None]
PAGE = "id string, title string, content string, parent_id string, ord int"


def silent(message: str) -> None:
    """A progress listener that does nothing."""


def ingest(spark: SparkSession, root: str, config: Config | None = None) -> dict[str, DataFrame]:
    """A local project: files, its name, and its file tree as one text."""
    config = config or Config()
    files = durable(scan_directory(spark, root, config.max_file_size, config.max_files))
    tree = docmap.file_tree(files).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("a"))
    return {"files": files, "name": project_name(files, Path(root).name), "tree": tree.select(F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("tree"))}


def links_of(files: DataFrame) -> DataFrame:
    """Resolved imports of files."""
    return imports.resolve_imports(imports.parse_imports(files), files).withColumnRenamed("module", "target_module")


def internal_edges(links: DataFrame) -> DataFrame:
    return links.where("target_file is not null").select(F.col("source_file").alias("src"), F.col("target_file").alias("dst"))


def analyse(
    spark: SparkSession, root: str, config: Config | None = None, client: generation.Client = generation.offline,
    on_progress: Progress = silent
) -> dict[str, DataFrame]:
    """The tables of a project: files, name, tree, imports (resolved), ranks, symbols, patterns, kind of project, and answers by module."""
    config = config or Config()
    on_progress("scanning")
    tables = ingest(spark, root, config)
    files = tables["files"]
    on_progress("resolving imports")
    links = durable(links_of(files))
    on_progress("reading symbols")
    found = durable(symbols.parse_symbols(files))
    on_progress("generating documents")
    asked = generation.module_prompts(files, module_name)
    answers = durable(generation.complete(asked, client, concurrency=config.concurrency))
    ranks = graph.page_rank(files.select(F.col("path").alias("id")), internal_edges(links))
    return tables | {
        "imports": links, "ranks": ranks, "symbols": found, "patterns": patterns.recognise(found),
        "project": generation.project_type(files), "documents": answers
    }


def structure(tables: dict[str, DataFrame]) -> DataFrame:
    """summary: one row of text about the project's structure, for planning its documents."""
    deps = index.module_dependencies(tables["imports"]).groupBy("src_module").agg(F.collect_set("dst_module").alias("targets"))
    deps = deps.agg(F.collect_list(F.struct("src_module", "targets")).alias("deps"))
    first = tables["ranks"].orderBy(F.col("score").desc(), "id").limit(15).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "id"))).alias("core"))
    rows = tables["tree"].crossJoin(deps).crossJoin(first)
    return rows.select(prompts.structure_summary(F.col("tree"), F.col("deps"), F.transform("core", lambda x: x["id"])).alias("summary"))


DOC_MAP = (
    "categories array<struct<id:string,title:string,description:string,parent_id:string,ord:int>>, "
    "docs array<struct<id:string,title:string,category_id:string,purpose:string,patterns:array<string>,depends_on:array<string>,ord:int>>"
)


def document_map(tables: dict[str, DataFrame], client: generation.Client = generation.offline, tries: int = 3, language: str = "en") -> tuple[DataFrame, DataFrame]:
    """(categories, docs) as the client plans them in at most `tries` answers, or by module where it plans nothing."""
    asked = structure(tables).select(F.lit("map").alias("id"), prompts.document_map(F.col("summary"), language).alias("prompt"))
    for _ in range(tries):
        plan = durable(generation.json_answers(generation.complete(asked, client, concurrency=1).where("status = 'success'"), DOC_MAP))
        if not plan.where(F.size("docs") > 0).isEmpty():
            made = plan.select(F.inline("categories")), plan.select(F.inline("docs"))
            return docmap.in_chinese(*made) if language == "zh" else made
    modules = tables["files"].groupBy(module_name(F.col("path")).alias("module")).agg(F.count("*").alias("n_files"))
    return docmap.default_map(modules)


def document_prompts(tables: dict[str, DataFrame], docs: DataFrame, language: str = "en", most_files: int = 20) -> DataFrame:
    """id, prompt, memo, referenced for docs: the files each covers, in order of path, and how their modules depend on each other."""
    covered = docmap.relevant_files(tables["files"], docs.withColumnRenamed("id", "doc_id"), internal_edges(tables["imports"]))
    files = covered.join(tables["files"].select("path", "language", "content"), "path")
    ranked = files.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("path", "language", "content"))), 1, most_files).alias("files"))
    ready = docs.join(ranked.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("context", prompts.files_context(F.col("files")))
    needs = F.array_join(F.col("depends_on"), ", ")
    memo = F.concat_ws(":", F.lit("doc"), "id", F.substring(F.sha2(F.substring("context", 1, 5000), 256), 1, 24))
    return ready.select(
        "id", prompts.document(F.col("title"), F.col("purpose"), F.col("context"), needs, language).alias("prompt"), memo.alias("memo"),
        prompts.referenced(F.col("context")).alias("referenced")
    )


def generate_documents(
    tables: dict[str, DataFrame], docs: DataFrame, client: generation.Client = generation.offline, records: DataFrame | None = None,
    cache: DataFrame | None = None, concurrency: int = 5, language: str = "en"
) -> DataFrame:
    """doc_id, content, memo, status for docs: texts in cache(memo, answer) are taken from there; with records(doc_id, status) a run is resumed
    and documents that have succeeded are taken from the cache or not at all; the others are asked for."""
    asked = durable(document_prompts(tables, docs, language))
    todo = asked
    if records is not None:
        todo = state.pending(asked.withColumnRenamed("id", "doc_id"), records, "resume").withColumnRenamed("doc_id", "id")
    if cache is not None:
        todo = generation.uncached(todo, cache)
    new = generation.complete(todo, client, concurrency=concurrency).join(asked, "id")
    done = new.select(F.col("id").alias("doc_id"), render_pages.with_references(F.col("answer"), F.col("referenced"), language).alias("content"), "memo", "status")
    if cache is None:
        return durable(done)
    kept = asked.join(cache.select("memo", F.col("answer").alias("content")), "memo")
    return durable(done.union(kept.select(F.col("id").alias("doc_id"), "content", "memo", F.lit("success").alias("status"))))


def overview_page(tables: dict[str, DataFrame], overview: DataFrame | None = None, language: str = "zh") -> DataFrame:
    """The index page from one row of overview's fields, or from the project's name, type and entry points."""
    files = tables["files"].orderBy("path").limit(20).agg(F.sort_array(F.collect_list(F.struct("path", "is_config", "is_entrypoint"))).alias("files"))
    if overview is None:
        entries = tables["files"].where("is_entrypoint").agg(F.sort_array(F.collect_list("path")).alias("entries"))
        rows = tables["name"].crossJoin(tables["project"]).crossJoin(entries)
        blank = "array<struct<name:string,version:string,category:string>>"
        overview = rows.select(
            "name", F.lit("").alias("one_liner"), F.lit("").alias("description"), "project_type",
            F.slice("entries", 1, 5).alias("entry_points"), F.array().cast(blank).alias("tech_stack"),
            F.array().cast("array<string>").alias("key_features"), F.array().cast("array<string>").alias("setup_instructions")
        )
    o = F.struct(*overview.columns)
    text = render_pages.overview_page(o, F.col("files"), language)
    return overview.crossJoin(files).select(
        F.lit("index").alias("id"), F.lit("Overview").alias("title"), text.alias("content"), F.lit("").alias("parent_id"),
        F.lit(0).alias("ord")
    )


def dependency_page(tables: dict[str, DataFrame], order: int = 100) -> DataFrame:
    """The page of module dependencies; no row where no module depends on another."""
    drawn = render.module_diagram(tables["files"], index.module_dependencies(tables["imports"])).where("diagram <> ''")
    core = tables["ranks"].orderBy(F.col("score").desc(), "id").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "id"))).alias("core"))
    entries = index.entry_points(tables["files"], tables["imports"]).orderBy("path").limit(10).agg(F.sort_array(F.collect_list("path")).alias("entries"))
    text = render_pages.dependency_page(F.col("diagram"), F.transform("core", lambda x: x["id"]), F.col("entries"))
    return drawn.crossJoin(core).crossJoin(entries).select(
        F.lit("dependencies").alias("id"), F.lit("Dependencies").alias("title"), text.alias("content"), F.lit("").alias("parent_id"),
        F.lit(order).alias("ord")
    )


def _entry(pages: DataFrame, place: int) -> DataFrame:
    path = F.array(F.struct(F.lit(place).alias("kind"), F.lit(0).alias("ord"), F.col("id").alias("id")))
    return pages.select(path.alias("sort_path"), F.lit(0).alias("depth"), "title", F.col("id").alias("page_id"))


def from_map(
    tables: dict[str, DataFrame], categories: DataFrame, docs: DataFrame, generated: DataFrame, overview: DataFrame | None = None,
    language: str = "zh"
) -> tuple[DataFrame, DataFrame]:
    """(pages, sidebar entries): the index, the tree of categories, and the dependencies."""
    first, last = durable(overview_page(tables, overview, language)), durable(dependency_page(tables))
    middle, entries = docmap.category_branches(categories, docs, generated)
    return first.union(middle).union(last), _entry(first, 0).union(entries).union(_entry(last, 9))


def from_modules(
    tables: dict[str, DataFrame], modules: DataFrame, overview: DataFrame | None = None, architecture: DataFrame | None = None,
    guide: DataFrame | None = None, language: str = "zh"
) -> tuple[DataFrame, DataFrame]:
    """(pages, sidebar entries) of the flat form: index, architecture (a row of its fields), a page for each of modules (rows of the
    fields of a module), reading guide, dependencies."""
    size = modules.select("*", F.coalesce(F.size("files"), F.lit(0)).alias("n")).orderBy(F.col("n").desc(), "name")
    fields = F.struct(*modules.columns)
    page = lambda df, name, title, text, order: df.select(
        F.lit(name).alias("id"), F.lit(title).alias("title"), text.alias("content"), F.lit("").alias("parent_id"), F.lit(order).alias("ord")
    )
    own = size.select(
        F.concat(F.lit("modules/"), "name").alias("id"), F.col("name").alias("title"),
        render_pages.module_page(fields, language).alias("content"), F.lit("modules").alias("parent_id"), (-F.col("n")).alias("ord")
    )
    parts = [(durable(overview_page(tables, overview, language)), 0)]
    if architecture is not None:
        parts.append(
            (
                page(
                    architecture.where("architecture_type <> ''"), "architecture", "Architecture",
                    render_pages.architecture_page(F.struct(*architecture.columns), language), 1
                ),
                1
            )
        )
    if guide is not None:
        parts.append((page(guide.where(F.size("steps") > 0), "reading-guide", "Reading Guide", render_pages.guide_page(F.struct(*guide.columns), language), 10), 3))
    parts.append((durable(dependency_page(tables, 11)), 9))
    head = F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("ord"), F.lit("").alias("id")))
    entries = own.limit(1).select(head.alias("sort_path"), F.lit(0).alias("depth"), F.lit("Modules").alias("title"), F.lit("").alias("page_id"))
    entries = entries.union(
        own.select(
            F.concat(head, F.array(F.struct(F.lit(0).alias("kind"), F.col("ord").alias("ord"), F.col("id").alias("id")))), F.lit(1),
            "title", "id"
        )
    )
    every = own
    for df, place in parts:
        every, entries = every.union(df), entries.union(_entry(df, place))
    return every, entries


def legacy_modules(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of a module's fields from the answers by module, where they are JSON of those fields, else with the answer as description."""
    answers = tables["documents"].where("status = 'success'")
    read = generation.json_answers(answers, render_pages.MODULE)
    paths = tables["files"].groupBy(module_name(F.col("path")).alias("id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "path", F.lit("").alias("purpose"),
                    F.array().cast("array<struct<name:string,kind:string,line:int,description:string>>").alias("key_symbols")
                )
            )
        ).alias("own")
    )
    rows = answers.select("id", "answer").join(read, "id", "left").join(paths, "id", "left")
    return rows.select(
        F.coalesce("name", "id").alias("name"), "purpose", F.coalesce("description", "answer").alias("description"),
        F.coalesce("files", "own").alias("files"), "relationships", "key_concepts"
    )


def metadata_of(project: str, categories: DataFrame, docs: DataFrame, generated: DataFrame, pages: DataFrame) -> DataFrame:
    """json: catalogs of the categories, items of the written documents, and their relations."""
    titles = categories.select(F.col("id").alias("parent_id"), F.col("title").alias("above"))
    named = categories.join(titles, "parent_id", "left").withColumn("catalog", metadata.key_of(F.coalesce("above", F.lit("")), F.col("title")))
    made = named.select(F.col("catalog").alias("id"), F.col("title").alias("name"), F.coalesce("above", F.lit("")).alias("parent_id")).distinct()
    written = docs.join(
        generated.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi"
    ).join(named.select(F.col("id").alias("category_id"), "catalog"), "category_id")
    listed = metadata.items(
        written.select(
            F.col("catalog").alias("catalog_id"), "title",
            F.coalesce(render_pages.given(F.col("purpose")), F.col("title")).alias("description"), F.lit("").alias("parent_id")
        )
    )
    pairs = metadata.relations(listed.select(F.col("catalog_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("PARENT_CHILD").alias("kind")))
    item = F.lit("WIKI_ITEM")
    links = pairs.select(
        F.col("rel_id").cast("long").alias("id"), "source_id", "target_id", item.alias("source_type"), item.alias("target_type"),
        F.col("kind").alias("relationship_type"), F.lit("").alias("extra")
    )
    return metadata.document(project, made, listed, links, pages)


def build(
    spark: SparkSession, root: str, out: str, title: str | None = None, config: Config | None = None,
    client: generation.Client = generation.offline, records: DataFrame | None = None, mode: str | None = None,
    on_progress: Progress = silent
) -> DataFrame:
    """Scan root and write its wiki to out. Mode `full` writes everything anew, `incremental` what differs from the last run's record,
    `resume` asks only for documents without a success in records(doc_id, status). Returns the new record id, hash."""
    config = config or Config()
    mode = mode or config.generation_mode
    tables = analyse(spark, root, config, client, on_progress)
    categories, docs = (durable(x) for x in document_map(tables, client, language=config.language))
    on_progress("writing documents")
    generated = generate_documents(tables, docs, client, records if mode == "resume" else None, None, config.concurrency, config.language)
    good = generated.where("status = 'success'").select("doc_id", "content")
    if good.isEmpty():
        pages, entries = from_modules(tables, legacy_modules(tables), language=config.language)
    else:
        pages, entries = from_map(tables, categories, docs, good, language=config.language)
    drawn = generation.pattern_document(tables["patterns"]).where("content <> '# Architecture\n\n'")
    extra = durable(
        drawn.select(
            F.lit("architecture").alias("id"), F.lit("Architecture").alias("title"), "content", F.lit("").alias("parent_id"),
            F.lit(50).alias("ord")
        )
    )
    pages, entries = durable(pages.union(extra)), entries.union(_entry(extra, 8))
    name = title or tables["name"].first().name
    on_progress("writing files")
    record = sinks.export_markdown(
        pages, render.sidebar(entries), out, name, "incremental" if mode in ("incremental", "resume") else "full",
        metadata_of(name, categories, docs, good, pages)
    )
    on_progress("done")
    return record

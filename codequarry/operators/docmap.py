"""Document maps: which files a document covers, its place among categories, trees of folders and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.files import chinese_id, glob_regex, has_chinese, title_of
from codequarry.operators.pages import category_page
from codequarry.session import durable, numbered, written

#: Globs of nothing but wildcards, and characters of globs that are broadcast at most.
MOST_BARE, MOST_SHORT = 10_000, 100_000
#: Paths or globs in a task that cuts them into windows, at least.
A_TASK = 20_000
#: Characters of the windows by which literals are looked up. A literal is cut into those of the largest size that it has.
WIDTHS = (1, 2, 4, 8, 16, 32, 64)


def _literals(pattern: Column) -> Column:
    """Texts that whatever a glob matches must contain: what stands between its wildcards and classes."""
    return F.filter(F.split(F.regexp_replace(pattern, r"\[[^\]]*\]", "*"), r"[*?\[\]]+"), lambda x: x != "")


def _width(literal: Column) -> Column:
    return F.greatest(*(F.when(F.length(literal) >= w, w) for w in WIDTHS))


def _windows(text: Column, width: Column) -> Column:
    """Hashes of all stretches of so many characters; none if the text is shorter."""
    last = F.length(text) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(text, i, width)))).otherwise(F.array().cast("array<bigint>"))


def _dealt(rows: DataFrame, column: str) -> DataFrame:
    """rows in tasks of bounded size, by count as each row becomes many."""
    return rows.repartition(max(8, min(10_000, rows.count() // A_TASK)), column)


def _tests(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """path, pattern, regex: which globs each path is tested against. A glob's literals are cut into windows, and so is every path, in the same sizes; a glob
    meets the paths that hold the window of it that the fewest paths hold, none if one of its windows stands in no path. Both sides are joined by the
    window's hash, so paths are passed over twice however many globs there are. Globs of nothing but wildcards meet all."""
    pattern = F.col("pattern")
    keys = F.flatten(F.transform(_literals(pattern), lambda x: _windows(x, _width(x))))
    wanted = _dealt(globs, "pattern").select("pattern", F.explode(F.array_distinct(keys)).alias("key"))
    widths = [r.w for r in globs.select(F.explode(F.transform(_literals(pattern), _width)).alias("w")).distinct().collect()]  # seven at most
    held = F.concat(F.array().cast("array<bigint>"), *(_windows(F.col("path"), F.lit(w)) for w in sorted(widths)))
    held = _dealt(paths, "path").select("path", F.explode(F.array_distinct(held)).alias("key"))
    short = globs.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0] <= MOST_SHORT  # a glob has no more windows than characters
    counts = held.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi") if short else held
    counts = counts.groupBy("key").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "key", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("x"))
    rarest = written(rarest.where("x.n > 0").select("pattern", glob_regex(pattern).alias("regex"), "x.key"))
    rarest = F.broadcast(rarest) if short else rarest.hint("merge")  # compressed files look small enough to broadcast when their rows are not
    met = held.join(rarest, "key").select("path", "pattern", "regex")
    bare = globs.where(F.size(_literals(pattern)) == 0).select("pattern", glob_regex(pattern).alias("regex"), F.lit(1).alias("one"))
    bare = F.broadcast(bare) if bare.count() <= MOST_BARE else bare
    return met.union(paths.select("path", F.lit(1).alias("one")).join(bare, "one").select("path", "pattern", "regex"))


def matching_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, path: files(path) that a glob of docs(doc_id, patterns) matches."""
    globs = durable(docs.select("doc_id", F.explode("patterns").alias("pattern")).distinct())
    each = durable(globs.select("pattern").distinct())
    hits = _tests(written(files.select("path").distinct()), each).where(F.regexp("path", F.col("regex")))
    return hits.join(globs, "pattern").select("doc_id", "path").distinct()


def relevant_files(files: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, path: the files of a document's globs, their neighbours in edges(src, dst), and the files of the globs of documents that it
    depends on, for docs(doc_id, patterns, depends_on)."""
    own = matching_files(files, docs)
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = own.join(both, own["path"] == both["src"]).select("doc_id", F.col("dst").alias("path"))
    needed = docs.select("doc_id", F.explode("depends_on").alias("on")).join(own.select(F.col("doc_id").alias("on"), "path"), "on").select("doc_id", "path")
    return own.union(near).union(needed).distinct().join(files.select("path"), "path", "left_semi").select("doc_id", "path")


def missing_dependencies(imports: DataFrame, module_files: DataFrame) -> DataFrame:
    """target_file, source_file: files outside module_files(path) that those import, each with its first importer."""
    inside = imports.join(module_files.select(F.col("path").alias("source_file")), "source_file", "left_semi").where(F.col("target_file").isNotNull())
    outside = inside.join(module_files.select(F.col("path").alias("target_file")), "target_file", "left_anti")
    return outside.groupBy("target_file").agg(F.min("source_file").alias("source_file"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """id, depth, path (titles joined by /) for nodes(id, parent_id, title); roots have an empty or null parent. A turn adds a level."""
    level = durable(nodes.where("coalesce(parent_id, '') = ''").select("id", F.lit(0).alias("depth"), F.col("title").alias("path")))
    out = level
    children = nodes.where("coalesce(parent_id, '') <> ''").select(F.col("id").alias("child"), "parent_id", "title")
    while not level.isEmpty():
        level = durable(
            level.join(children, level["id"] == children["parent_id"]).select(
                F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "title").alias("path")
            )
        )
        out = out.union(level)
    return out


def tree_entries(files: DataFrame) -> DataFrame:
    """entry, depth, is_dir: every file of files(path) and each of its folders, once."""
    parts = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
            F.array_join(F.slice(parts, F.lit(1), i), "/").alias("entry"), (i - 1).alias("depth"), (i < F.size(parts)).alias("is_dir")
        )
    )
    return files.select(F.inline(prefixes)).distinct()


def file_tree(files: DataFrame, most: int = 200) -> DataFrame:
    """line_no, line: the entries in order, indented by depth, folders with a slash; beyond `most` a last line tells how many there are more."""
    entries = tree_entries(files)
    first = entries.orderBy("entry").limit(most).select(
        "entry",
        F.concat(
            F.repeat(F.lit("  "), F.col("depth")), F.element_at(F.split("entry", "/"), -1), F.when(F.col("is_dir"), "/").otherwise("")
        ).alias("line")
    )
    numbered = first.agg(
        F.sort_array(F.collect_list(F.struct("entry", "line"))).alias("a")
    ).select(F.posexplode("a").alias("line_no", "x")).select("line_no", F.col("x.line").alias("line"))
    more = entries.agg((F.count("*") - most).alias("rest")).where("rest > 0").select(
        F.lit(most).alias("line_no"), F.format_string("... and %d more entries", "rest").alias("line")
    )
    return numbered.union(more)


def default_map(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories, docs): a category with one document for each module(module, n_files), larger ones first: what stands in for a map where
    none was generated."""
    by_size = numbered(modules.select((-F.col("n_files")).alias("k"), "module"), ["k", "module"], "ord")
    slug = F.lower(F.translate("module", " _", "--"))
    named = by_size.select(slug.alias("id"), title_of(F.col("module")).alias("title"), F.lit("").alias("parent_id"), F.col("ord").cast("int").alias("ord"), "module")
    docs = named.select(
        F.concat("id", F.lit("/overview")).alias("id"), "title", F.col("id").alias("category_id"), F.concat(
            F.lit("What the module "), "module", F.lit(" does")
        ).alias("purpose"),
        F.array(F.concat("module", F.lit("/*"))).alias("patterns"), F.array().cast("array<string>").alias("depends_on"), "ord",
    )
    return named.select("id", "title", F.lit("").alias("description"), "parent_id", "ord"), docs


def doc(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("id") == doc_id).limit(1)


def category(categories: DataFrame, category_id: str) -> DataFrame:
    return categories.where(F.col("id") == category_id).limit(1)


def docs_in(docs: DataFrame, category_id: str) -> DataFrame:
    return docs.where(F.col("category_id") == category_id)


def child_categories(categories: DataFrame, category_id: str) -> DataFrame:
    return categories.where(F.col("parent_id") == category_id)


def in_chinese(categories: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ids and titles in Chinese where their words are known, unless the first id of either is Chinese already."""
    first = lambda df: df.agg(F.min_by("id", "ord").alias("id")).where(has_chinese(F.col("id")))
    if not first(categories).isEmpty() or not first(docs).isEmpty():
        return categories, docs
    put = lambda df, *names: df.withColumns({c: chinese_id(F.col(c)) for c in names})
    return put(categories, "id", "title", "parent_id"), put(docs, "id", "title", "category_id")


def category_branches(categories: DataFrame, docs: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, entries) of the tree of categories(id, title, description, parent_id, ord) with docs(id, title, category_id, purpose, ord), of
    which generated(doc_id, content) are written.

    pages: id, title, content, parent_id, ord: an index for a category with three documents, and the documents. entries, the sidebar: sort_path,
    depth, title, page_id: a category's documents, then its categories. A category without a written document below it is left out,
    but for a root that has documents. The tree is walked a level a turn."""
    step = F.struct(F.lit(1).alias("kind"), F.col("ord").alias("ord"), F.col("id").alias("id"))
    known = categories.select("id", "title", "description", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "ord")
    level = durable(known.where("parent_id = ''").withColumn("path", F.array(step)))
    tree = level
    while not level.isEmpty():
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = durable(known.join(above, "parent_id").withColumn("path", F.concat("above", F.array(step))).select(*tree.columns))
        tree = tree.union(level)
    written = docs.join(generated.groupBy("doc_id").agg(F.min("content").alias("content")).withColumnRenamed("doc_id", "id"), "id", "left")
    placed = written.join(tree.select(F.col("id").alias("category_id"), "path"), "category_id")
    alive = placed.where("content is not null").select(F.explode(F.transform("path", lambda p: p["id"])).alias("id")).distinct()
    shown = placed.select(F.col("category_id").alias("id")).distinct().join(tree.where("parent_id = ''").select("id"), "id").union(alive).distinct()
    row = F.struct("ord", "id", "title", "purpose", F.col("content").isNotNull().alias("done"))
    lists = placed.groupBy("category_id").agg(F.sort_array(F.collect_list(row)).alias("docs")).where(F.size("docs") >= 3)
    index = tree.join(lists.withColumnRenamed("category_id", "id"), "id")
    parent = F.when(F.col("parent_id") == "", F.col("id")).otherwise(F.col("parent_id"))
    index_pages = index.select(
        F.concat(F.lit("category/"), "id").alias("id"), "title", category_page(F.struct("title", "description"), F.col("docs")).alias("content"),
        F.concat(F.lit("category/"), parent).alias("parent_id"), F.col("ord"),
    )
    done = placed.where("content is not null")
    doc_pages = done.select(F.concat(F.lit("docs/"), "id").alias("id"), "title", "content", F.concat(F.lit("category/"), "category_id").alias("parent_id"), "ord")
    has_index = index.select("id", F.lit(True).alias("has"))
    heads = tree.join(shown, "id", "left_semi").join(has_index, "id", "left")
    page_id = F.when(F.col("has"), F.concat(F.lit("category/"), "id")).otherwise("")
    own = F.struct(F.lit(0).alias("kind"), F.col("ord").alias("ord"), F.col("id").alias("id"))
    entries = heads.select(F.col("path").alias("sort_path"), (F.size("path") - 1).alias("depth"), "title", page_id.alias("page_id")).union(
        done.select(F.concat("path", F.array(own)), F.size("path"), "title", F.concat(F.lit("docs/"), "id"))
    )
    return index_pages.union(doc_pages), entries

"""Queries over indexes and graphs that are kept up, and over the components of the page-link graph.

Each of the former builds the state of an earlier day from the given table (a tenth of the rows is missing, a tenth has other texts, a tenth stands
once more under another name), then updates it to the table as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.automaton import keyword_pairs
from codequarry.operators import chunking, components, docmap, graph, search
from codequarry.operators.kept_graph import KeptGraph
from codequarry.plans.catalog import CHUNKS_SQL, FILES_SQL, LINKS_SQL, PART_EDGES_SQL, _chunks, _files, _part_edges
from codequarry.plans.registry import ORACLES, query
from codequarry.session import own_folder, table, written
from codequarry.sources import files as sources


def _work(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "kind string, n long")


# ---- retrieval index ------------------------------------------------------------------------------


def _earlier_documents(docs: DataFrame) -> DataFrame:
    """documents as of before: ids that end in 0 are missing, those in 1 have another line, those in 2 stand under another source too."""
    last = F.pmod("doc_id", F.lit(10))
    text = F.when(last == 1, F.concat("text", F.lit("\nwords of an earlier day"))).otherwise(F.col("text")).alias("text")
    before = docs.where(last != 0).select("doc_id", text, "lang", "source")
    return before.unionByName(docs.where(last == 2).select("doc_id", "text", "lang", F.concat(F.lit("old_"), "source").alias("source")))


def _chunks_of(docs: DataFrame) -> DataFrame:
    rows = chunking.line_chunks(sources.document_files(docs))
    return rows.select(F.concat("path", F.lit("#"), F.lpad(F.col("chunk_no").cast("string"), 6, "0")).alias("chunk_id"), "content")


def _updated_index(spark: SparkSession, d: str) -> tuple[search.KeptIndex, dict[str, int]]:
    index = search.KeptIndex(spark, own_folder(spark, "index"))
    index.update(_chunks_of(_earlier_documents(table(spark, d, "documents"))))
    return index, index.update(_chunks(spark, d).select("chunk_id", "content"))


@query("rag_kept_index", ORACLES["rag_topk"])
def rag_kept_index(spark, d):  # noqa: ANN001, ANN201
    """Searching an index that was built earlier, updated and merged gives what searching a new one gives."""
    index, _ = _updated_index(spark, d)
    index.merge()
    return index.search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content")))


EARLIER_SQL = """(SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || chr(10) || 'words of an earlier day' ELSE text END AS text, lang, source FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id, text, lang, 'old_' || source FROM documents WHERE doc_id % 10 = 2)"""
KEPT_SQL = CHUNKS_SQL.split(",\nwords AS")[0]


@query(
    "rag_kept_index_work",
    f"""WITH after_chunks AS (WITH {KEPT_SQL} SELECT * FROM kept),
before_chunks AS (WITH {KEPT_SQL.replace("FROM documents", "FROM " + EARLIER_SQL)} SELECT * FROM kept),
pair AS (SELECT a.chunk_id AS a, b.chunk_id AS b, a.content AS new, b.content AS old FROM after_chunks a FULL JOIN before_chunks b ON a.chunk_id = b.chunk_id)
SELECT 'added' AS kind, count(*) AS n FROM pair WHERE b IS NULL
UNION ALL SELECT 'changed', count(*) FROM pair WHERE a IS NOT NULL AND b IS NOT NULL AND new <> old
UNION ALL SELECT 'removed', count(*) FROM pair WHERE a IS NULL
UNION ALL SELECT 'contents_cut', count(DISTINCT new) FROM pair WHERE a IS NOT NULL AND new NOT IN (SELECT content FROM before_chunks)""",
)
def rag_kept_index_work(spark, d):  # noqa: ANN001, ANN201
    """What an update looked at: chunks that came, changed and went, and contents that were cut into words."""
    return _work(spark, _updated_index(spark, d)[1])


# ---- links that are kept up -----------------------------------------------------------------------


def _page_files(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("id"), sources.page_path(F.col("url")).alias("path"), F.col("html").alias("content"))


def _page_link_rows(files: DataFrame) -> DataFrame:
    rows = files.select("id", F.posexplode(sources.page_targets(F.col("content"))).alias("no", "module"))
    return rows.withColumn("candidates", F.array(sources.page_path(F.col("module"))))


def _earlier_pages(pages: DataFrame) -> DataFrame:
    """pages as of before: ids that end in 0 are missing, those in 1 link elsewhere, those in 2 have another address."""
    last = F.pmod("page_id", F.lit(10))
    html = F.when(last == 1, F.replace("html", F.lit('href="'), F.lit('href="/earlier'))).otherwise(F.col("html"))
    url: Column = F.when(last == 2, F.concat("url", F.lit("/earlier"))).otherwise(F.col("url"))
    return pages.where(last != 0).select("page_id", url.alias("url"), html.alias("html"))


def _updated_graph(spark: SparkSession, d: str) -> tuple[KeptGraph, dict[str, int]]:
    pages = table(spark, d, "pages")
    kept = KeptGraph(spark, own_folder(spark, "graph"), _page_link_rows, sources.page_names)
    kept.update(_page_files(_earlier_pages(pages)))
    return kept, kept.update(_page_files(pages))


@query("kept_links", f"WITH {LINKS_SQL} SELECT * FROM links")
def kept_links(spark, d):  # noqa: ANN001, ANN201
    """Links of a graph that was built earlier and updated are those of a new one."""
    links = _updated_graph(spark, d)[0].links()
    return links.select(F.col("source").alias("source_file"), F.col("module").alias("target_module"), F.col("target").alias("target_file"), F.col("target").isNull().alias("is_external"))


PATH_SQL = "regexp_replace(regexp_replace({}, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"
PAGES_SQL = f"""after_pages AS (SELECT page_id, {PATH_SQL.format("url")} AS path, html FROM pages),
before_pages AS (SELECT page_id, {PATH_SQL.format("CASE WHEN page_id % 10 = 2 THEN url || '/earlier' ELSE url END")} AS path,
  CASE WHEN page_id % 10 = 1 THEN replace(html, 'href="', 'href="/earlier') ELSE html END AS html FROM pages WHERE page_id % 10 <> 0),
names_after AS (SELECT DISTINCT unnest([path, regexp_extract(path, '^/[^/]+')]) AS name FROM after_pages),
names_before AS (SELECT DISTINCT unnest([path, regexp_extract(path, '^/[^/]+')]) AS name FROM before_pages),
touched AS ((SELECT * FROM names_after EXCEPT SELECT * FROM names_before) UNION (SELECT * FROM names_before EXCEPT SELECT * FROM names_after)),
moved AS (SELECT a.page_id FROM after_pages a LEFT JOIN before_pages b ON a.page_id = b.page_id WHERE b.page_id IS NULL OR a.path <> b.path OR a.html <> b.html),
linked AS (SELECT page_id, {PATH_SQL.format("u")} AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u FROM after_pages)),
again AS (SELECT page_id IN (SELECT page_id FROM moved) OR name IN (SELECT name FROM touched) AS again FROM linked)"""


@query(
    "kept_links_work",
    f"""WITH {PAGES_SQL} SELECT 'files_parsed' AS kind, count(*) AS n FROM moved UNION ALL SELECT 'files_removed', 0
UNION ALL SELECT 'links_resolved', count(*) FROM again WHERE again UNION ALL SELECT 'links_kept', count(*) FROM again WHERE NOT again""",
)
def kept_links_work(spark, d):  # noqa: ANN001, ANN201
    """What an update looked at: files parsed and removed, links resolved and left alone."""
    return _work(spark, _updated_graph(spark, d)[1])


# ---- components and cycles ------------------------------------------------------------------------


def _page_edges(spark: SparkSession, d: str) -> DataFrame:
    links = sources.page_links(table(spark, d, "pages")).where("target_file is not null")
    return links.select(F.col("source_file").alias("src"), F.col("target_file").alias("dst"))


EDGES_SQL = f"{LINKS_SQL}, e AS (SELECT DISTINCT source_file AS src, target_file AS dst FROM links WHERE target_file IS NOT NULL AND source_file <> target_file)"


@query(
    "page_components",
    f"""WITH RECURSIVE {EDGES_SQL}, v AS (SELECT {PATH_SQL.format("url")} AS id FROM pages UNION SELECT src FROM e UNION SELECT dst FROM e),
reach AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
same AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT id, component FROM same""",
)
def page_components(spark, d):  # noqa: ANN001, ANN201
    """The strongly connected component of every page, named by its smallest page."""
    vertices = table(spark, d, "pages").select(sources.page_path(F.col("url")).alias("id"))
    return components.strong_components(_page_edges(spark, d), vertices)


@query(
    "part_components",
    f"""WITH RECURSIVE {PART_EDGES_SQL}, reach AS (SELECT p_partkey AS a, p_partkey AS b FROM part UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
same AS (SELECT x.a AS id, min(x.b) AS component, count(*) AS size FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT id, component, size FROM same""",
)
def part_components(spark, d):  # noqa: ANN001, ANN201
    """The strongly connected component of every part, and how many parts are in it."""
    found = written(components.strong_components(_part_edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("id"))))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("id", "component", "size")


@query(
    "part_cycles",
    f"""WITH {PART_EDGES_SQL}, two AS (SELECT a.src AS x, a.dst AS y FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst),
three AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
SELECT array_to_string([x, y, x], ' ') AS cycle FROM two UNION ALL SELECT array_to_string([x, y, z, x], ' ') FROM three""",
)
def part_cycles(spark, d):  # noqa: ANN001, ANN201
    """Cycles of two or three parts; only edges inside components are walked."""
    return graph.cycles(components.inner_edges(_part_edges(spark, d)), 3).select(F.array_join("cycle", " ").alias("cycle"))


# ---- many keywords, many globs ---------------------------------------------------------------------


@query(
    "keyword_documents",
    """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]{6,}')) AS keyword FROM benchmark)
SELECT keyword, count(*) AS n_documents FROM k JOIN documents ON contains(lower(text), keyword) GROUP BY keyword""",
)
def keyword_documents(spark, d):  # noqa: ANN001, ANN201
    """In how many documents each word of six letters or more of the benchmark stands, as a part of a word too."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), F.lit(0))).alias("keyword"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return keyword_pairs(texts, words).groupBy("keyword").agg(F.count("*").alias("n_documents"))


def _globs(files: DataFrame) -> DataFrame:
    """A glob for each path: by its name, by the start of its name, by a class in its suffix, or by its folders."""
    name = F.substring_index("path", "/", -1)
    stem = F.substring_index(name, ".", 1)
    n = F.length("path")
    glob = F.when(n % 4 == 0, F.concat(F.lit("*/"), name)).when(n % 4 == 1, F.concat(F.lit("*"), F.left(stem, F.length(stem) - 1), F.lit("?.*")))
    glob = glob.when(n % 4 == 2, F.concat(F.lit("src[0-9]*"), F.right(stem, F.lit(3)), F.lit(".t[xy]t"))).otherwise(F.concat(F.lit("?"), F.substring("path", 2, 100)))
    return files.select(glob.alias("doc_id"), F.array(glob).alias("patterns")).distinct()


@query(
    "glob_matches",
    f"""WITH {FILES_SQL}, p AS (SELECT path, string_split(path, '/')[-1] AS name, string_split(string_split(path, '/')[-1], '.')[1] AS stem, length(path) AS n FROM files),
g AS (SELECT DISTINCT CASE n % 4 WHEN 0 THEN '*/' || name WHEN 1 THEN '*' || left(stem, length(stem) - 1) || '?.*' WHEN 2 THEN 'src[0-9]*' || right(stem, 3) || '.t[xy]t'
ELSE '?' || substr(path, 2) END AS pattern FROM p)
SELECT pattern, count(*) AS n_files, min(path) AS first_path FROM g JOIN p ON path GLOB pattern GROUP BY pattern""",
)
def glob_matches(spark, d):  # noqa: ANN001, ANN201
    """Files that each of as many globs as there are paths matches."""
    files = _files(spark, d).select("path")
    hits = docmap.matching_files(files, _globs(files))
    return hits.groupBy(F.col("doc_id").alias("pattern")).agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))

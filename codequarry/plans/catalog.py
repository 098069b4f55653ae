"""Named queries over the given tables, each beside the SQL that says the same.

documents stand for files (path = source/lang/doc_<id>.txt), links between pages and trade between nations for imports, customers and
suppliers for symbols. What needs source code runs on the small corpus of plans/corpus.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import files as f
from codequarry.operators import chunking, components, docmap, generation, graph, imports, index, metadata, patterns, render, retrieval, search, state, symbol_graph, symbols
from codequarry.operators import pages as wiki_pages
from codequarry.plans import corpus
from codequarry.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from codequarry.session import dealt, durable, numbered, table
from codequarry.sources import files as sources
from codequarry.sources import sinks

#: documents as files, for the SQL side.
FILES_SQL = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, len(string_split(text, chr(10))) AS lines, length(text) AS size, text AS content FROM documents)"
LINKS_SQL = """links AS (SELECT p.source_file, p.target_module, k.path AS target_file, k.path IS NULL AS is_external FROM
  (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS source_file, unnest(regexp_extract_all(html, 'href="([^"]*)"',
1)) AS target_module FROM pages) p
  LEFT JOIN (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages UNION
SELECT regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^/[^/?#]+')
FROM pages) k ON k.path = regexp_replace(regexp_replace(p.target_module, '^[a-z]+://[^/]*', ''), '[?#].*$', ''))"""
TRADE_SQL = """trade AS (SELECT DISTINCT s.s_nationkey AS src, c.c_nationkey AS dst FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return sources.document_files(table(spark, d, "documents"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return sources.page_links(table(spark, d, "pages"))


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose supplier sold to a customer of another."""
    lots = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o, c, s = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = lots.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return corpus.paths(table(spark, d, "documents"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    return corpus.code_files(table(spark, d, "documents"))


PATHS_SQL = corpus.PATHS_SQL
LANG_CASES = "CASE " + " ".join(f"WHEN ext = '{ext}' THEN '{lang}'" for ext, lang in f.LANGUAGES.items()) + " ELSE 'unknown' END"
IN = lambda xs: "(" + ", ".join(corpus.quoted(x) for x in xs) + ")"

# ---- files ---------------------------------------------------------------------------------------


@query(
    "file_language_breakdown",
    f"""WITH {FILES_SQL} SELECT language, count(*) AS n_files FROM files GROUP BY language ORDER BY n_files DESC, language LIMIT 10""",
)
def file_language_breakdown(spark, d):  # noqa: ANN001, ANN201
    return index.language_breakdown(_files(spark, d))


@query("file_total_lines", f"WITH {FILES_SQL} SELECT count(*) AS n_files, sum(lines)::BIGINT AS total_lines FROM files")
def file_total_lines(spark, d):  # noqa: ANN001, ANN201
    return _files(spark, d).agg(F.count("*").alias("n_files"), F.sum("lines").alias("total_lines"))


@query(
    "detect_language",
    f"""WITH p AS (SELECT path, lower(string_split(path, '/')[-1]) AS name FROM {PATHS_SQL}), e AS (SELECT *, regexp_extract(name, '^.+\\.([^.]+)$', 1) AS ext
FROM p)
SELECT path, CASE WHEN name = 'dockerfile' OR name LIKE 'dockerfile.%' THEN 'dockerfile' WHEN name = 'makefile' THEN 'makefile' ELSE {LANG_CASES} END
AS language FROM e""",
)
def detect_language(spark, d):  # noqa: ANN001, ANN201
    return _paths(spark, d).select("path", f.language(F.col("path")).alias("language"))


@query(
    "file_roles",
    f"""WITH p AS (SELECT path, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM {PATHS_SQL})
SELECT path, name IN {IN(f.CONFIG_NAMES)} AS is_config,
(name IN {IN(f.ENTRY_NAMES)} OR (len(parts) >= 2 AND parts[-2] IN {IN(f.ENTRY_DIRS)})) AS is_entrypoint,
  regexp_matches(lower(name), '({"|".join(s.replace(".", chr(92) + ".") for s in f.SKIP_SUFFIXES)})$') AS skipped, list_has_any(parts[1:-2],
{list(f.SKIP_DIRS)}) OR len(list_filter(parts[1:-2], lambda x: x LIKE '%.egg-info')) > 0 AS in_skipped_dir,
  regexp_matches(path, '{f.NOISE}') AS is_noise FROM p""",
)
def file_roles(spark, d):  # noqa: ANN001, ANN201
    p = F.col("path")
    return _paths(spark, d).select(
        "path", f.is_config(p).alias("is_config"), f.is_entrypoint(p).alias("is_entrypoint"), f.has_skipped_suffix(p).alias("skipped"),
        f.in_skipped_dir(p).alias("in_skipped_dir"), f.is_noise(p).alias("is_noise")
    )


@query(
    "scan_order",
    f"""WITH p AS (SELECT path, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM {PATHS_SQL})
SELECT path, row_number() OVER (ORDER BY CASE WHEN name IN {IN(f.CONFIG_NAMES)} THEN 0 WHEN name IN {IN(f.ENTRY_NAMES)} OR (len(parts) >= 2 AND
parts[-2] IN {IN(f.ENTRY_DIRS)}) THEN 1 ELSE 2 END, path)::INTEGER AS place FROM p""",
)
def scan_order(spark, d):  # noqa: ANN001, ANN201
    ranked = _paths(spark, d).withColumn("rank", f.scan_rank(F.col("path")))
    return numbered(ranked, ["rank", "path"], "place").select("path", F.col("place").cast("int").alias("place"))


@query("size_filter", f"WITH {FILES_SQL} SELECT path, size FROM files WHERE size > 0 AND size <= 10000")
def size_filter(spark, d):  # noqa: ANN001, ANN201
    return sources.wanted(_files(spark, d), max_bytes=10_000).select("path", "size")


@query(
    "minified_filter",
    """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a.js' WHEN doc_id % 3 = 1 THEN 'b.CSS' ELSE 'c.py' END AS path,
CASE WHEN doc_id % 2 = 0 THEN translate(text, chr(10), ' ') || chr(10) || 'x' ELSE text END AS text FROM documents),
l AS (SELECT *, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest, len(list_filter(string_split(text, chr(10)),
lambda x: trim(x, ' ' || chr(9)) <> '')) AS filled FROM m)
SELECT doc_id, path, path <> 'c.py' AND longest >= 1000 AND (filled <= 5 OR longest > length(text) * 0.5) AS looks_minified FROM l""",
)
def minified_filter(spark, d):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, "a.js").when(i % 3 == 1, "b.CSS").otherwise("c.py")
    text = F.when(i % 2 == 0, F.concat(F.translate("text", "\n", " "), F.lit("\nx"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), f.looks_minified(path, text).alias("looks_minified"))


@query(
    "module_names",
    f"""WITH {FILES_SQL}, p AS (SELECT path FROM files UNION ALL SELECT path FROM {PATHS_SQL}), q AS (SELECT path, string_split(path, '/') AS s FROM p)
SELECT CASE WHEN len(s) <= 1 THEN 'root' WHEN s[1] IN {IN(f.WRAPPER_DIRS)} AND len(s) > 2 THEN s[2] ELSE s[1] END AS module,
CASE WHEN len(s) <= 1 THEN 'root' ELSE s[1] END AS top, s[1] AS first, count(*) AS n
FROM q GROUP BY ALL""",
)
def module_names(spark, d):  # noqa: ANN001, ANN201
    p = F.col("path")
    every = _files(spark, d).select("path").union(_paths(spark, d))
    return every.groupBy(f.module_name(p).alias("module"), f.top_folder(p).alias("top"), f.first_part(p).alias("first")).agg(F.count("*").alias("n"))


@query("preview_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS preview FROM documents")
def preview_lines(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", f.preview(F.col("text"), 3).alias("preview"))


@query("content_hashes", "SELECT doc_id, substr(sha256(text), 1, 24) AS content_hash, md5(text) AS page_hash FROM documents")
def content_hashes(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", f.content_hash(F.col("text")).alias("content_hash"), F.md5("text").alias("page_hash"))


@query(
    "git_urls",
    "SELECT doc_id, x.head || doc_id || x.tail AS url, x.host, x.owner, CASE WHEN x.repo = '' THEN '' ELSE x.repo || doc_id END AS repo FROM "
    + corpus.dealt_sql([(i, *u) for i, u in enumerate(corpus.URLS)], "head, tail, host, owner, repo", len(corpus.URLS)),
)
def git_urls(spark, d):  # noqa: ANN001, ANN201
    rows = corpus.dealt(table(spark, d, "documents"), [u[:2] for u in corpus.URLS], ["head", "tail"])
    return rows.select("doc_id", F.concat("head", "doc_id", "tail").alias("url")).select("doc_id", "url", *f.git_url_parts(F.col("url")))


@query("project_name", "SELECT 'acme-tool' AS name")
def project_name(spark, d):  # noqa: ANN001, ANN201
    rows = [("package.json", '{"name": "@acme/tool"}'), ("pyproject.toml", '[project]\nname = "other"\n'), ("a.py", "name = 1")]
    return sources.project_name(spark.createDataFrame(rows, "path string, content string"), "folder")


@query(
    "file_tree",
    f"""WITH {FILES_SQL}, p AS (SELECT string_split(path, '/') AS s
FROM files), e AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS entry, (i - 1)::INTEGER AS depth, i < len(s) AS is_dir
FROM p, unnest(range(1, len(s) + 1)) AS t(i)) SELECT * FROM e""",
)
def file_tree(spark, d):  # noqa: ANN001, ANN201
    return docmap.tree_entries(_files(spark, d))


# ---- chunks and retrieval ------------------------------------------------------------------------


@query(
    "rag_chunks",
    f"WITH {FILES_SQL}, l AS (SELECT path, string_split(content, chr(10)) AS s FROM files), c AS (SELECT path, i, s FROM l, unnest(range(0, ((len(s) + 29) // 30)::BIGINT)) AS t(i))\n"
    "SELECT path, i::INTEGER AS chunk_no, (30 * i + 1)::INTEGER AS start_line, least(30 * i + 30, len(s))::INTEGER AS end_line, md5(array_to_string(s[30 * i + 1:30 * i + 30], chr(10))) AS hash FROM c WHERE trim(array_to_string(s[30 * i + 1:30 * i + 30], chr(10)), ' ' || chr(10)) <> ''",
)
def rag_chunks(spark, d):  # noqa: ANN001, ANN201
    return chunking.line_chunks(_files(spark, d)).select("path", "chunk_no", "start_line", "end_line", F.md5("content").alias("hash"))


def _chunks(spark, d):  # noqa: ANN001, ANN202
    """Chunks by an id that sorts as files and chunks do."""
    rows = chunking.line_chunks(_files(spark, d))
    return rows.select(F.concat("path", F.lit("#"), F.lpad(F.col("chunk_no").cast("string"), 6, "0")).alias("chunk_id"), "content", "path", "start_line", "end_line")


CHUNKS_SQL = f"""{FILES_SQL}, lined AS (SELECT path, string_split(content, chr(10)) AS s
FROM files), chunks AS (SELECT path || '#' || lpad(i::VARCHAR, 6, '0') AS chunk_id, array_to_string(s[30 * i + 1:30 * i + 30], chr(10)) AS content
  FROM lined, unnest(range(0, ((len(s) + 29) // 30)::BIGINT)) AS t(i)),
kept AS (SELECT * FROM chunks WHERE trim(content, ' ' || chr(10)) <> ''),
words AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-zA-Z_][\\p{{L}}\\p{{N}}_]*')) AS token FROM kept),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM words GROUP BY ALL), n AS (SELECT count(*) AS n FROM kept),
idf AS (SELECT token, ln((SELECT n FROM n) / (count(*) + 1)) AS idf FROM tf GROUP BY token)"""


@query("rag_tf", f"WITH {CHUNKS_SQL} SELECT token, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY token")
def rag_tf(spark, d):  # noqa: ANN001, ANN201
    return retrieval.frequencies(retrieval.chunk_terms(_chunks(spark, d))[0])


@query(
    "rag_norms",
    f"""WITH {CHUNKS_SQL} SELECT chunk_id, round(sqrt(sum(tf * idf * tf * idf)), 4) AS norm FROM tf JOIN idf USING (token) WHERE idf <> 0 GROUP BY chunk_id""",
)
def rag_norms(spark, d):  # noqa: ANN001, ANN201
    terms, n = retrieval.chunk_terms(_chunks(spark, d))
    idf = durable(retrieval.inverse_frequencies(retrieval.frequencies(terms), n))
    return retrieval.norms(retrieval.weighted(terms.select("chunk_id", F.inline("terms")), idf)).select("chunk_id", F.round("norm", 4).alias("norm"))


@query(
    "rag_topk",
    f"""WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, token, tf * idf AS w FROM tf JOIN idf USING (token)
WHERE idf <> 0), norm AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY chunk_id),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][\\p{{L}}\\p{{N}}_]*')) AS token FROM benchmark),
qw AS (SELECT query_id, token, count(*) * any_value(idf) AS qw FROM q JOIN idf USING (token) WHERE idf <> 0
GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY query_id),
s AS (SELECT query_id, chunk_id, round(sum(w * qw) / (any_value(norm) * any_value(qn)), 6) AS score FROM w JOIN qw USING (token)
JOIN norm USING (chunk_id) JOIN qn USING (query_id) GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INTEGER AS rank, chunk_id, score FROM s
WHERE score > 0) SELECT * FROM r WHERE rank <= 5""",
)
def rag_topk(spark, d):  # noqa: ANN001, ANN201
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    return search.top_chunks(_chunks(spark, d).select("chunk_id", "content"), asked)


@query(
    "chat_context",
    "SELECT conv_id AS query_id, string_agg('### ' || role || ' (lines ' || turn || '-' || turn || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context, count(*)::INTEGER AS n_refs FROM conversations GROUP BY conv_id",
)
def chat_context(spark, d):  # noqa: ANN001, ANN201
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("path"), F.col("turn").alias("start_line"),
        F.col("turn").alias("end_line"), F.col("text").alias("content")
    )
    return retrieval.chat_context(turns).select("query_id", "context", F.size("refs").alias("n_refs"))


CODE_SQL = corpus.CODE_SQL
STRUCTURE_KIND = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for p, k in chunking.STRUCTURES) + " END"
STRUCTURE_NAME = "CASE " + " ".join(
    f"WHEN regexp_matches(x, '{p}') THEN " + (f"regexp_extract(x, '{p}', 1)" if r"(\w+)" in p else f"'{k}'") for p, k in chunking.STRUCTURES
) + " END"


@query(
    "structural_chunks",
    f"""WITH RECURSIVE {FILES_SQL}, {corpus.LISTED_SQL}, every AS (SELECT path, content FROM code UNION ALL SELECT path, content
FROM files), s AS (SELECT path, string_split(content, chr(10)) AS l FROM every),
t AS (SELECT path, i::INTEGER AS i, length(l[i + 1]) + 1 AS n, regexp_replace(l[i + 1], '^\\s+|\\s+$', '', 'g') AS x, len(l) AS lines
FROM s, unnest(range(0, len(l))) AS u(i)), k AS (SELECT *, {STRUCTURE_KIND} AS kind, {STRUCTURE_NAME} AS name FROM t),
f AS (SELECT path, -1 AS i, 0 AS start, 0::BIGINT AS size, NULL::VARCHAR AS kind, NULL::VARCHAR AS name, false AS cut, 0 AS c_start,
NULL::VARCHAR AS c_kind, NULL::VARCHAR AS c_name, 0::BIGINT AS lines FROM s UNION ALL
  SELECT k.path, k.i, CASE WHEN c.cut THEN k.i ELSE f.start END, CASE WHEN c.cut THEN 0 ELSE f.size END + k.n, coalesce(k.kind,
CASE WHEN NOT c.cut THEN f.kind END), coalesce(CASE WHEN NOT c.cut THEN f.name END, k.name), c.cut, f.start, f.kind, f.name, k.lines
  FROM f JOIN k ON k.path = f.path AND k.i = f.i + 1,
LATERAL (SELECT k.i > f.start AND (f.size >= 4000 OR (k.kind IS NOT NULL AND f.size >= 2400)) AS cut) c),
chunks AS (SELECT path, c_start AS a, i - 1 AS b, c_kind AS kind, c_name AS name, false AS last FROM f WHERE cut UNION ALL
SELECT path, start, i, kind, name, true FROM f WHERE i >= 0 AND i = lines - 1),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY a) - 1 AS no FROM chunks)
SELECT path, 'chunk-' || no AS chunk_id, (a + 1)::INTEGER AS start_line, (b + 1)::INTEGER AS end_line, coalesce(kind,
CASE WHEN last THEN 'tail' ELSE 'block' END) AS chunk_type, coalesce(name, CASE WHEN last THEN 'tail' ELSE 'block-' || no END) AS chunk_name FROM n""",
)
def structural_chunks(spark, d):  # noqa: ANN001, ANN201
    every = corpus.listed_files(spark).select("path", "content").union(_files(spark, d).select("path", "content"))
    return chunking.structural_chunks(every).select("path", "chunk_id", "start_line", "end_line", "chunk_type", "chunk_name")


@query(
    "line_chunks_code",
    f"""WITH RECURSIVE {CODE_SQL}, s AS (SELECT path, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM (SELECT path, string_split(content, chr(10)) AS l
FROM code)),
k AS (SELECT path, i::INTEGER AS i, trim(l[i + 1]) = '' AS blank, len(l) AS lines FROM s, unnest(range(0, len(l))) AS u(i)),
f AS (SELECT path, -1 AS i, 0 AS start, false AS closed, 0 AS c_start FROM s UNION ALL
  SELECT k.path, k.i, CASE WHEN c.closed THEN k.i + 1 ELSE f.start END, c.closed, f.start FROM f JOIN k ON k.path = f.path AND k.i = f.i + 1,
  LATERAL (SELECT k.i - f.start + 1 >= 30 OR (k.blank AND k.i - f.start + 1 >= 5) OR k.i = k.lines - 1 AS closed) c), n AS (SELECT *,
row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS no FROM f WHERE closed)
SELECT n.path, no::INTEGER AS chunk_no, c_start + 1 AS start_line, n.i + 1 AS end_line FROM n JOIN s ON s.path = n.path
WHERE trim(array_to_string(l[c_start + 1:n.i + 1], ''), ' ' || chr(10)) <> ''""",
)
def line_chunks_code(spark, d):  # noqa: ANN001, ANN201
    return chunking.line_chunks(_code(spark, d)).select("path", "chunk_no", "start_line", "end_line")


# ---- imports and their index ---------------------------------------------------------------------


@query(
    "parse_imports_rust",
    f"""WITH {CODE_SQL}, l AS (SELECT path, s[i] AS raw0, i::INTEGER AS line FROM (SELECT path, string_split(content, chr(10)) AS s FROM code
WHERE language = 'rust'), unnest(range(1, len(s) + 1)) AS t(i)),
c AS (SELECT path, line, trim(string_split(raw0, '//')[1]) AS raw FROM l)
SELECT path AS source_file, regexp_extract(raw, '^use\\s+([\\w:]+)', 1) AS module, 'import' AS kind, line, NOT regexp_matches(raw,
'^use\\s+(crate|super|self)') AS is_external, raw FROM c WHERE regexp_matches(raw, '^use\\s+[\\w:]')
UNION ALL SELECT path, regexp_extract(raw, '^mod\\s+(\\w+)', 1), 'mod', line, false, raw FROM c WHERE regexp_matches(raw, '^mod\\s+\\w')""",
)
def parse_imports_rust(spark, d):  # noqa: ANN001, ANN201
    return imports.parse_imports(_code(spark, d).where("language = 'rust'")).select("source_file", "module", "kind", "line", "is_external", "raw")


@query(
    "parse_imports",
    "SELECT folder || source_file AS source_file, language, module, name, kind, line::INTEGER AS line, is_external, raw FROM "
    + corpus.by_file(corpus.IMPORTED, "source_file, language, module, name, kind, line, is_external, raw"),
)
def parse_imports(spark, d):  # noqa: ANN001, ANN201
    return imports.parse_imports(_code(spark, d))


@query(
    "resolve_imports",
    f"""WITH r AS (SELECT * FROM {corpus.by_file([(*i[:3], i[5], i[6], t[4], corpus.FILE_NUMBER.get(t[4], -1)) for i, t in zip(corpus.IMPORTED, corpus.RESOLVED, strict=True)], "source_file, language, module, line, is_external, target, number")}),
t AS (SELECT r.*, CASE WHEN r.module LIKE '.%' AND d.doc_id IS NOT NULL THEN folder || target END AS target_file
FROM r LEFT JOIN documents d ON d.doc_id = project * {len(corpus.FILES)} + number AND number >= 0)
SELECT folder || source_file AS source_file, language, module, line::INTEGER AS line, target_file, is_external AND target_file IS NULL AS is_external FROM t""",
)
def resolve_imports(spark, d):  # noqa: ANN001, ANN201
    """Each project's relative imports resolve to its own files."""
    code = _code(spark, d)
    return imports.resolve_imports(imports.parse_imports(code), code).select("source_file", "language", "module", "line", "target_file", "is_external")


@query(
    "importers",
    f"""WITH {LINKS_SQL} SELECT target_file, count(*) AS n_imports, count(DISTINCT source_file) AS n_files FROM links WHERE NOT is_external
GROUP BY target_file""",
)
def importers(spark, d):  # noqa: ANN001, ANN201
    return index.importer_counts(_links(spark, d))


@query(
    "external_index",
    f"""WITH {LINKS_SQL} SELECT target_module, count(DISTINCT source_file) AS n_files FROM links WHERE is_external GROUP BY target_module""",
)
def external_index(spark, d):  # noqa: ANN001, ANN201
    return index.external_index(_links(spark, d)).select("target_module", F.size("files").cast("long").alias("n_files"))


@query(
    "dependency_indexes",
    f"""WITH {FILES_SQL}, {LINKS_SQL} SELECT 'language' AS index, language AS key, path FROM files UNION ALL SELECT 'module', string_split(path, '/')[1], path
FROM files
UNION ALL SELECT DISTINCT 'external', target_module, source_file FROM links WHERE is_external""",
)
def dependency_indexes(spark, d):  # noqa: ANN001, ANN201
    return index.indexes(_files(spark, d), _links(spark, d))


@query(
    "imports_of_file",
    f"""WITH {LINKS_SQL} SELECT source_file, target_module, target_file FROM links WHERE source_file = (SELECT min(source_file) FROM links)""",
)
def imports_of_file(spark, d):  # noqa: ANN001, ANN201
    links = _links(spark, d)
    first = links.agg(F.min("source_file")).first()[0] or ""
    return index.imports_of(links, first).select("source_file", "target_module", "target_file")


@query(
    "first_wins",
    """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def first_wins(spark, d):  # noqa: ANN001, ANN201
    return sources.first_of_each(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("path_slashes", "SELECT doc_id, replace(source || chr(92) || lang || '/x', chr(92), '/') AS path FROM documents")
def path_slashes(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", f.forward_slashes(F.concat("source", F.lit("\\"), "lang", F.lit("/x"))).alias("path"))


@query("symbol_density", "SELECT p_brand AS file, count(*) AS n_symbols FROM part GROUP BY p_brand")
def symbol_density(spark, d):  # noqa: ANN001, ANN201
    return symbols.symbol_density(table(spark, d, "part").select(F.col("p_brand").alias("file")))


@query(
    "entry_points",
    f"WITH {LINKS_SQL}, f AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages), n AS (SELECT target_file, count(*) AS n FROM links WHERE target_file IS NOT NULL GROUP BY target_file)\nSELECT path, coalesce(n, 0) AS n_imports FROM f LEFT JOIN n ON n.target_file = f.path WHERE coalesce(n, 0) <= 1",
)
def entry_points(spark, d):  # noqa: ANN001, ANN201
    links = _links(spark, d)
    return index.entry_points(
        links.select(F.col("source_file").alias("path")).union(
            table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""))
        ).distinct(),
        links
    )


@query(
    "module_dependencies",
    f"""WITH {TRADE_SQL}, n AS (SELECT t.*, a.n_regionkey AS ra, b.n_regionkey AS rb FROM trade t JOIN nation a ON a.n_nationkey = t.src
JOIN nation b ON b.n_nationkey = t.dst)
SELECT DISTINCT 'r' || ra AS src_module, 'r' || rb AS dst_module FROM n WHERE ra <> rb""",
)
def module_dependencies(spark, d):  # noqa: ANN001, ANN201
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("path"))
    t = _trade(spark, d).join(
        n.select(F.col("n_nationkey").alias("src"), F.col("path").alias("source_file")), "src"
    ).join(n.select(F.col("n_nationkey").alias("dst"), F.col("path").alias("target_file")), "dst")
    return index.module_dependencies(t.withColumn("is_external", F.lit(False)))


FILE_LINKS_SQL = f"{LINKS_SQL}, pf AS (SELECT DISTINCT source_file AS path, 'l' || length(source_file) % 3 AS language, length(source_file) AS lines FROM links)"


def _link_files(links: DataFrame) -> DataFrame:
    n = F.length("source_file")
    return links.select(F.col("source_file").alias("path"), F.concat(F.lit("l"), (n % 3).cast("string")).alias("language"), n.cast("long").alias("lines")).distinct()


@query(
    "dependency_statistics",
    f"WITH {FILE_LINKS_SQL} SELECT (SELECT count(*) FROM pf) AS total_files, (SELECT count(DISTINCT CASE WHEN len(string_split(path, '/')) <= 1 THEN 'root' ELSE string_split(path, '/')[1] END) FROM pf) AS module_count, (SELECT count(DISTINCT language) FROM pf) AS language_count, (SELECT count(*) FROM links) AS total_imports, (SELECT count(DISTINCT target_module) FROM links WHERE is_external) AS external_dependencies, (SELECT list_sort(list(DISTINCT target_module))[1:50] FROM links WHERE is_external) AS top_external",
)
def dependency_statistics(spark, d):  # noqa: ANN001, ANN201
    links = _links(spark, d)
    return index.statistics(_link_files(links), links)


@query(
    "language_statistics",
    f"""WITH {FILE_LINKS_SQL}, n AS (SELECT source_file AS path, count(*) AS n FROM links GROUP BY 1)
SELECT language, count(*) AS file_count, sum(coalesce(n, 0))::BIGINT AS total_imports, round(avg(coalesce(n, 0)), 6) AS avg_imports_per_file FROM pf
LEFT JOIN n USING (path) GROUP BY language""",
)
def language_statistics(spark, d):  # noqa: ANN001, ANN201
    links = _links(spark, d)
    return index.language_statistics(_link_files(links), links)


@query(
    "module_statistics",
    f"""WITH {FILE_LINKS_SQL}, n AS (SELECT source_file AS path, count(*) FILTER (WHERE NOT is_external) AS i, count(*) FILTER (WHERE is_external) AS e
FROM links GROUP BY 1), m AS (SELECT CASE WHEN len(string_split(path, '/')) <= 1 THEN 'root' ELSE string_split(path, '/')[1] END AS module, lines, i,
e FROM pf LEFT JOIN n USING (path))
SELECT module, count(*) AS file_count, sum(lines)::BIGINT AS total_lines, sum(coalesce(i, 0))::BIGINT AS internal_imports, sum(coalesce(e,
0))::BIGINT AS external_imports FROM m GROUP BY module""",
)
def module_statistics(spark, d):  # noqa: ANN001, ANN201
    links = _links(spark, d)
    return index.module_statistics(_link_files(links), links)


@query(
    "search_files",
    f"""WITH {FILES_SQL} SELECT path FROM files WHERE contains(lower(path), 'doc_1') AND language = 'en' AND string_split(path, '/')[1] = 'src1'""",
)
def search_files(spark, d):  # noqa: ANN001, ANN201
    return index.search_files(_files(spark, d), "DOC_1", language="en", module="src1").select("path")


# ---- graphs --------------------------------------------------------------------------------------


#: Twenty turns of ranking the vertices v(id) over the edges e(src, dst).
PAGE_RANK_SQL = """deg AS (SELECT src, count(*) AS deg FROM e GROUP BY src),
pr AS (SELECT 0 AS turn, id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS score FROM v UNION ALL
  SELECT p.turn + 1, v.id,
    0.85 * (coalesce(sum(CASE WHEN e.dst = v.id THEN p.score / deg.deg END),
0) + sum(CASE WHEN deg.deg IS NULL THEN p.score ELSE 0 END) / (SELECT count(*) FROM v)) + 0.15 / (SELECT count(*) FROM v)
  FROM pr p CROSS JOIN v LEFT JOIN deg ON deg.src = p.id LEFT JOIN e ON e.src = p.id AND e.dst = v.id WHERE p.turn < 20 GROUP BY p.turn, v.id)
SELECT id, round(score, 6) AS score FROM pr WHERE turn = 20"""


@query(
    "pagerank_files",
    f"""WITH RECURSIVE {TRADE_SQL}, e AS (SELECT * FROM trade WHERE src <> dst), v AS (SELECT n_nationkey AS id FROM nation), {PAGE_RANK_SQL}""",
)
def pagerank_files(spark, d):  # noqa: ANN001, ANN201
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return graph.page_rank(nations, _trade(spark, d), most=20, tolerance=0).select("id", F.round("score", 6).alias("score"))


PAGE_GRAPH_SQL = f"""{LINKS_SQL}, e AS (SELECT DISTINCT source_file AS src, target_file AS dst FROM links WHERE NOT is_external AND source_file <> target_file),
v AS (SELECT source_file AS id FROM links UNION SELECT target_file FROM links WHERE NOT is_external)"""


def _page_ranks(spark, d):  # noqa: ANN001, ANN202
    links = _links(spark, d)
    edges = links.where("not is_external").select(F.col("source_file").alias("src"), F.col("target_file").alias("dst"))
    pages = links.select(F.col("source_file").alias("id")).distinct()
    return graph.page_rank(pages, edges, most=20, tolerance=0).select("id", F.round("score", 6).alias("score"))


@query("pagerank_pages", f"WITH RECURSIVE {PAGE_GRAPH_SQL}, {PAGE_RANK_SQL}")
def pagerank_pages(spark, d):  # noqa: ANN001, ANN201
    return _page_ranks(spark, d)


@query("core_files", f"WITH RECURSIVE {PAGE_GRAPH_SQL}, {PAGE_RANK_SQL} ORDER BY score DESC, id LIMIT 10")
def core_files(spark, d):  # noqa: ANN001, ANN201
    return _page_ranks(spark, d).orderBy(F.col("score").desc(), "id").limit(10)


BUYS_SQL = "buys AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), both_ways AS (SELECT a AS src, b AS dst FROM buys UNION SELECT b, a FROM buys)"


def _buys(spark, d):  # noqa: ANN001, ANN202
    lots = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    pairs = lots.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    pairs = dealt(pairs, lots.count(), "o_custkey", "l_suppkey").distinct()  # numbers are told apart faster than names
    return pairs.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


@query("related_files_d1", f"WITH {BUYS_SQL} SELECT src AS start, dst AS id, 1 AS depth FROM both_ways WHERE src IN ('s1', 's2')")
def related_files_d1(spark, d):  # noqa: ANN001, ANN201
    return graph.related(_buys(spark, d), spark.createDataFrame([("s1",), ("s2",)], "id string"), 1)


@query(
    "related_files_d2",
    f"""WITH RECURSIVE {BUYS_SQL}, r AS (SELECT 's1' AS id, 0 AS depth UNION SELECT b.dst, r.depth + 1 FROM r JOIN both_ways b ON b.src = r.id
WHERE r.depth < 2) SELECT 's1' AS start, id, min(depth)::INTEGER AS depth FROM r WHERE id <> 's1' GROUP BY id""",
)
def related_files_d2(spark, d):  # noqa: ANN001, ANN201
    return graph.related(_buys(spark, d), spark.createDataFrame([("s1",)], "id string"), 2)


@query("pagerank_symbols")
def pagerank_symbols(spark, d):  # noqa: ANN001, ANN201
    """Customers and suppliers as symbols, all purchases as calls."""
    people = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(
        table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"))
    )
    return graph.page_rank(people, _buys(spark, d), most=20, tolerance=0).select("id", F.round("score", 9).alias("score"))


CALLS_SQL = "calls AS (SELECT * FROM " + corpus.values(corpus.CALLS, "src, dst") + ")"


def _part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts that follow each other in an order with nearly the same quantity."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("q"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).where(F.abs(F.col("l_quantity") - F.col("q")) <= 1).select(F.col("l_partkey").alias("src"), "dst").distinct()


PART_EDGES_SQL = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE abs(a.l_quantity - b.l_quantity) <= 1 AND a.l_partkey <> b.l_partkey)"""


@query(
    "call_chains",
    f"""WITH RECURSIVE {PART_EDGES_SQL}, s AS (SELECT min(src) AS s FROM e), ends AS (SELECT any_value(s) AS s, max(b.dst) AS t FROM s JOIN e a ON a.src = s JOIN e b ON b.src = a.dst
WHERE b.dst <> s), p AS (SELECT [s] AS chain, t FROM ends UNION ALL SELECT list_append(chain, dst), t FROM p JOIN e ON src = chain[-1]
WHERE chain[-1] <> t AND NOT list_contains(chain, dst) AND len(chain) <= 5) SELECT array_to_string(chain, '>') AS chain FROM p WHERE chain[-1] = t""",
)
def call_chains(spark, d):  # noqa: ANN001, ANN201
    """Chains of at most five steps from the smallest part to the largest that lies two steps from it."""
    edges = durable(_part_edges(spark, d).where("src <> dst"))
    first = edges.agg(F.min("src")).first()[0]
    two = edges.where(F.col("src") == first).select(F.col("dst").alias("src")).join(edges, "src").where(F.col("dst") != first)
    return graph.call_chains(edges, first, two.agg(F.max("dst")).first()[0], 5).select(F.array_join("chain", ">").alias("chain"))


@query(
    "cycles",
    f"""WITH RECURSIVE {PART_EDGES_SQL}, p AS (SELECT [src, dst] AS path, false AS closed FROM e
WHERE dst > src UNION ALL SELECT list_append(path, dst), dst = path[1] FROM p JOIN e ON src = path[-1]
WHERE NOT closed AND (dst = path[1] OR (dst > path[1] AND NOT list_contains(path, dst))) AND len(path) <= 6)
SELECT array_to_string(path, '>') AS cycle FROM p WHERE closed""",
)
def cycles(spark, d):  # noqa: ANN001, ANN201
    """Cycles of up to six parts; only edges inside components are walked."""
    return graph.cycles(components.inner_edges(_part_edges(spark, d)), 6).select(F.array_join("cycle", ">").alias("cycle"))


#: A map of regions, nations and suppliers: a nation needs its region, a supplier its nation and the supplier of half its number; suppliers
#: that end in 8 and 9 need each other.
def _map(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, n, s = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    key = F.col("s_suppkey")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    items = r.select(name("r", "r_regionkey").alias("id"), F.col("r_regionkey").cast("long").alias("ord"))
    items = items.union(n.select(name("n", "n_nationkey"), F.col("n_nationkey").cast("long") + 100)).union(s.select(name("s", key), F.lit(10**9) - key))
    half, other = F.when(key > 1, name("s", F.floor(key / 2))), F.when(key % 10 == 8, name("s", key + 1)).when(key % 10 == 9, name("s", key - 1))
    needs = s.select(name("s", key).alias("id"), F.explode(F.array(name("n", "s_nationkey"), half, other)).alias("on")).where(F.col("on").isNotNull())
    return items, needs.union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))


MAP_SQL = """bad AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 IN (8, 9) AND CASE WHEN s_suppkey % 10 = 8 THEN s_suppkey + 1 ELSE s_suppkey - 1 END IN (SELECT s_suppkey FROM supplier)
UNION SELECT s.s_suppkey FROM supplier s JOIN bad ON s.s_suppkey // 2 = bad.k AND s.s_suppkey > 1),
m AS (SELECT 'r' || r_regionkey AS id, r_regionkey::BIGINT AS ord, 0 AS level, 0::BIGINT AS a FROM region UNION ALL SELECT 'n' || n_nationkey, n_nationkey + 100, 1, n_regionkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 1000000000 - s_suppkey, CASE WHEN s_suppkey IN (SELECT k FROM bad) THEN NULL ELSE length(bin(s_suppkey)) + 1 END,
  CASE WHEN s_suppkey < 2 THEN n_regionkey * 1000 + n_nationkey ELSE 0 END FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query("topo_levels", f"WITH RECURSIVE {MAP_SQL} SELECT id, coalesce(level, -1)::INTEGER AS level, ord FROM m")
def topo_levels(spark, d):  # noqa: ANN001, ANN201
    return graph.levels(*_map(spark, d)).select("id", F.coalesce("level", F.lit(-1)).alias("level"), "ord")


@query("topo_order", f"WITH RECURSIVE {MAP_SQL} SELECT id, row_number() OVER (ORDER BY level NULLS LAST, CASE WHEN level IS NULL THEN 0 ELSE a END, ord) - 1 AS place FROM m")
def topo_order(spark, d):  # noqa: ANN001, ANN201
    """First in, first out: a supplier of a level stands behind the ones that its elders stand behind, and among siblings by its own order."""
    return graph.topological_ranks(*_map(spark, d))


# ---- symbols and patterns ------------------------------------------------------------------------


@query(
    "symbols_go",
    f"""WITH {CODE_SQL}, l AS (SELECT path, s[i] AS x, i::INTEGER AS line FROM (SELECT path, string_split(content, chr(10)) AS s FROM code
WHERE language = 'go'), unnest(range(1, len(s) + 1)) AS t(i)),
m AS (SELECT path, line, regexp_extract(x, '^func\\s+(\\w+)\\s*\\(', 1) AS fn, regexp_extract(x, '^type\\s+(\\w+)\\s+struct', 1) AS st,
regexp_extract(x, '^type\\s+(\\w+)\\s+interface', 1) AS it FROM l)
SELECT path AS file, fn || st || it AS name, CASE WHEN fn <> '' THEN 'function' WHEN st <> '' THEN 'class' ELSE 'interface' END AS kind, line,
CASE WHEN fn <> '' THEN 'func ' || fn || '(...)' ELSE 'type ' || st || it END AS signature FROM m WHERE fn || st || it <> ''""",
)
def symbols_go(spark, d):  # noqa: ANN001, ANN201
    return symbols.parse_symbols(_code(spark, d).where("language = 'go'")).select("file", "name", "kind", "line", "signature")


@query("symbols_all", "SELECT folder || file AS file, name, kind, line::INTEGER AS line FROM " + corpus.by_file(corpus.NAMED, "file, name, kind, line"))
def symbols_all(spark, d):  # noqa: ANN001, ANN201
    return symbols.parse_symbols(_code(spark, d).where(corpus.hand_written(F.col("path")))).select("file", "name", "kind", "line")


@query(
    "call_edges",
    f"""WITH s AS (SELECT folder || file AS file, name, folder || file || ':' || name || ':' || line AS id FROM {corpus.by_file(corpus.NAMED, "file, name, kind, line")}),
c AS (SELECT folder || file AS file, caller, callee, line::INTEGER AS line FROM {corpus.by_file(corpus.CALLED, "file, caller, callee, line")})
SELECT (SELECT max(id) FROM s WHERE s.file = c.file AND s.name = c.caller) AS source, (SELECT max(id) FROM s WHERE s.name = c.callee) AS target, 'calls' AS edge_type, line FROM c""",
)
def call_edges(spark, d):  # noqa: ANN001, ANN201
    code = _code(spark, d).where(corpus.hand_written(F.col("path")))
    return symbols.call_edges(code, symbols.parse_symbols(code))


@query(
    "symbol_kinds",
    "SELECT y.kind, coalesce(sum(c.n), 0)::BIGINT AS n FROM (SELECT unnest(['function', 'class', 'module', 'method', 'interface', 'variable', 'constant', 'property']) AS kind) y LEFT JOIN "
    + corpus.by_file(corpus.KINDS, "file, kind, n") + " c ON c.kind = y.kind GROUP BY y.kind",
)
def symbol_kinds(spark, d):  # noqa: ANN001, ANN201
    return symbols.kind_counts(symbols.parse_symbols(_code(spark, d)))


ARCH_VALUES = corpus.values([(n.upper(), w, k) for n, (k, w, _) in patterns.ARCHITECTURE.items()], "pattern, weight, keywords")


@query(
    "arch_patterns",
    f"""WITH s AS (SELECT lower(p_type) AS name, max(p_partkey) AS id FROM part GROUP BY 1 UNION ALL SELECT lower(event_type) || 'event', max(event_id)
FROM events GROUP BY 1), a AS (SELECT * FROM {ARCH_VALUES}), k AS (SELECT pattern, weight, len(keywords) AS n, unnest(keywords) AS keyword FROM a)
SELECT pattern, round(least(count(*) / any_value(n) + any_value(weight), 1.0), 6)::DOUBLE AS confidence, count(*) AS n_hits FROM k
JOIN s ON contains(s.name, k.keyword) GROUP BY pattern HAVING count(*) >= 2""",
)
def arch_patterns(spark, d):  # noqa: ANN001, ANN201
    parts = table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("id"))
    events = table(spark, d, "events").select(F.concat("event_type", F.lit("event")).alias("name"), F.col("event_id").alias("id"))
    return patterns.recognise(parts.union(events)).select("pattern", "confidence", "n_hits")


@query(
    "design_patterns",
    "WITH k AS (SELECT * FROM " + corpus.values(
        [(k, n, x) for k, (n, x) in patterns.DESIGN.items()], "pattern_key, pattern, features"
    ) + "), s AS (SELECT lower(event_type) || CASE WHEN event_id % 2 = 0 THEN 'Event' ELSE 'listener' END AS name FROM events), h AS (SELECT pattern_key, pattern FROM k, s WHERE len(list_filter(features, lambda x: contains(lower(s.name), x))) > 0)\nSELECT pattern_key, pattern, count(*) AS n_matches, least(count(*) / 4, 1.0)::DOUBLE AS confidence FROM h GROUP BY ALL HAVING count(*) >= 2",
)
def design_patterns(spark, d):  # noqa: ANN001, ANN201
    tail = F.when(F.col("event_id") % 2 == 0, "Event").otherwise("listener")
    return patterns.design_patterns(table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat("event_type", tail).alias("name")))


# ---- document maps, metadata, state --------------------------------------------------------------


def _glob_rows(spark, d):  # noqa: ANN001, ANN202
    return spark.createDataFrame(
        [("en", ["*/en/*"], []), ("ones", ["src?/*/doc_*1.txt"], ["en"]), ("low", ["src[0-4]/[!e]*/*9.txt"], [])],
        "doc_id string, patterns array<string>, depends_on array<string>"
    )


@query(
    "relevant_files_glob",
    f"""WITH {FILES_SQL}, own AS (SELECT 'en' AS doc_id, path FROM files WHERE regexp_full_match(path, '.*/en/.*') UNION SELECT 'ones', path FROM files
WHERE regexp_full_match(path, 'src./.*/doc_.*1\\.txt')
UNION SELECT 'low', path FROM files WHERE regexp_full_match(path, 'src[0-4]/[^e].*/.*9\\.txt')), e AS (SELECT a.path AS src, b.path AS dst
FROM files a JOIN files b ON length(a.content) = length(b.content) AND a.path < b.path),
both_ways AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT * FROM own UNION SELECT doc_id, dst FROM own
JOIN both_ways ON src = path UNION SELECT 'ones', path FROM own WHERE doc_id = 'en'""",
)
def relevant_files_glob(spark, d):  # noqa: ANN001, ANN201
    files = _files(spark, d)
    a, b = (files.select(F.col("path").alias(n), F.length("content").alias("size")) for n in ("src", "dst"))
    same = a.join(b, "size").where("src < dst").select("src", "dst")
    return docmap.relevant_files(files, _glob_rows(spark, d), same)


CATEGORY_SQL = f"""c AS (SELECT {corpus.FOLDER_SQL.format(n=len(corpus.CATEGORIES))} || x.id AS id, CASE WHEN x.parent_id <> '' THEN {corpus.FOLDER_SQL.format(n=len(corpus.CATEGORIES))} || x.parent_id ELSE x.parent_id END AS parent_id, x.title
FROM {corpus.dealt_sql([(i, *c) for i, c in enumerate(corpus.CATEGORIES)], "id, parent_id, title", len(corpus.CATEGORIES))})"""


@query(
    "category_tree",
    f"""WITH RECURSIVE {CATEGORY_SQL}, t AS (SELECT id, 0 AS depth, title AS path FROM c
WHERE coalesce(parent_id, '') = '' UNION ALL SELECT c.id, t.depth + 1, t.path || '/' || c.title FROM t JOIN c ON c.parent_id = t.id)
SELECT id, depth::INTEGER AS depth, path FROM t""",
)
def category_tree(spark, d):  # noqa: ANN001, ANN201
    rows = corpus.dealt(table(spark, d, "documents"), corpus.CATEGORIES, ["id", "parent_id", "title"])
    parent = F.when(F.col("parent_id") != "", F.concat("folder", "parent_id")).otherwise(F.col("parent_id"))
    return docmap.tree_paths(rows.select(F.concat("folder", "id").alias("id"), parent.alias("parent_id"), "title"))


@query(
    "region_tree",
    """SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation
JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 's' || s_suppkey, 2, r_name || '/' || n_name || '/' || s_name FROM supplier
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def region_tree(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name")
    return docmap.tree_paths(r.union(n).union(s))


@query(
    "catalog_upsert",
    """SELECT DISTINCT n_name AS name, 'r' || n_regionkey AS parent_id, substr(sha256('r' || n_regionkey || chr(31) || n_name), 1, 32) AS id FROM nation
JOIN supplier ON s_nationkey = n_nationkey""",
)
def catalog_upsert(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id")
    )
    return metadata.catalogs(rows).select("name", "parent_id", "id")



@query(
    "cache_latest_ttl",
    """WITH l AS (SELECT user_id AS key, ts AS created_at, event_type AS op, value, row_number() OVER (PARTITION BY user_id
ORDER BY ts DESC, event_id DESC) AS rn FROM events), m AS (SELECT max(ts) AS now FROM events) SELECT key, op, round(value, 6) AS value FROM l, m
WHERE rn = 1 AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', created_at)) <= 604800""",
)
def cache_latest_ttl(spark, d):  # noqa: ANN001, ANN201
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    log = events.select(F.col("user_id").alias("key"), F.col("ts").alias("created_at"), F.col("event_id").alias("eid"), F.col("event_type").alias("op"), "value")
    second = lambda c: F.unix_seconds(F.date_trunc("second", F.col(c)).cast("timestamp"))
    kept = state.latest(log).crossJoin(F.broadcast(now)).where(second("now") - second("created_at") <= state.TTL_SECONDS)
    return kept.select("key", "op", F.round("value", 6).alias("value"))


@query(
    "generation_status",
    """SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'success' WHEN quality = 0 THEN 'failed' END, 'pending') AS status FROM documents LEFT
JOIN labels USING (doc_id)""",
)
def generation_status(spark, d):  # noqa: ANN001, ANN201
    records = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    return state.statuses(table(spark, d, "documents"), records)


@query("incremental_diff", "SELECT doc_id AS id, md5(text) AS hash FROM documents WHERE doc_id % 3 <> 0")
def incremental_diff(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    before = docs.where("id % 3 <> 1").select("id", F.when(F.col("id") % 3 == 0, F.md5("content")).otherwise("stale").alias("hash"))
    return state.changed(docs, before).select("id", "hash")


@query("json_props", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS sum_k, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark, d):  # noqa: ANN001, ANN201
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count("*").alias("n"))


# ---- the symbol graph ----------------------------------------------------------------------------

KIND_LIST = ("function", "class", "method", "variable")
#: Nations as symbols in files of their regions, trade between them as edges of three types.
GRAPH_SQL = f"""{TRADE_SQL}, edges AS (SELECT 'n' || src AS source, 'n' || dst AS target, CASE WHEN k < 3 THEN 'calls' WHEN k = 3 THEN 'imports' ELSE 'uses' END AS edge_type, src * 100 + dst AS line
FROM (SELECT src, dst, (src * 7 + dst * 3) % 11 AS k FROM trade) WHERE k < 5),
nodes AS (SELECT 'n' || n_nationkey AS id, n_name AS name, {list(KIND_LIST)}[n_nationkey % 4 + 1] AS kind, 'r' || n_regionkey || '/n' || n_nationkey % 3 || '.py' AS file, n_nationkey + 1 AS line FROM nation)"""
RANK_SQL = """links AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'calls' AND source <> target), v AS (SELECT id FROM nodes UNION SELECT source
FROM links UNION SELECT target FROM links), deg AS (SELECT source, count(*) AS n FROM links GROUP BY source),
pr AS (SELECT 0 AS turn, id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS score FROM v UNION ALL
  SELECT p.turn + 1, v.id, 0.85 * (sum(CASE WHEN e.target IS NOT NULL THEN p.score / deg.n ELSE 0 END) + sum(CASE WHEN deg.n IS NULL THEN p.score ELSE
0 END) / (SELECT count(*) FROM v)) + 0.15 / (SELECT count(*) FROM v)
  FROM pr p CROSS JOIN v LEFT JOIN deg ON deg.source = p.id LEFT JOIN links e ON e.source = p.id AND e.target = v.id WHERE p.turn < 24
GROUP BY p.turn, v.id)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = (F.col("src") * 7 + F.col("dst") * 3) % 11
    kind = F.when(k < 3, "calls").when(k == 3, "imports").otherwise("uses").alias("edge_type")
    sold = durable(_trade(spark, d).where(k < 5))
    edges = sold.select(F.concat(F.lit("n"), "src").alias("source"), F.concat(F.lit("n"), "dst").alias("target"), kind, (F.col("src") * 100 + F.col("dst")).alias("line"), F.lit("").alias("raw"))
    key = F.col("n_nationkey")
    file = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), (key % 3).cast("string"), F.lit(".py")).alias("file")
    kinds = F.get(F.array(*(F.lit(x) for x in KIND_LIST)), (key % 4).cast("int")).alias("kind")
    nodes = table(spark, d, "nation").select(F.concat(F.lit("n"), key).alias("id"), F.col("n_name").alias("name"), kinds, file, (key + 1).alias("line"))
    return nodes.select("*", F.col("line").alias("end_line"), F.lit("").alias("signature"), F.lit("").alias("doc")), edges


CALL_ROWS = [(a, b, "calls", n) for n, (a, b) in enumerate(corpus.CALLS, 1)] + [("a", "e", "imports", 20), ("f", "b", "uses", 21)]
NODE_ROWS = [
    (x, x.upper(), k, p, n) for n, (x, k, p) in enumerate(
        (
            ("a", "function", "src/one/a.py"), ("b", "class", "src/one/a.py"), ("c", "method", "src/two/c.py"),
            ("d", "function", "src/two/c.py"), ("e", "variable", "e.py"), ("g", "function", "src/one/a.py")
        ),
        1
    )
]


def _listed_graph(spark):  # noqa: ANN001, ANN202
    edges = spark.createDataFrame(CALL_ROWS, "source string, target string, edge_type string, line int").withColumn("raw", F.lit(""))
    nodes = spark.createDataFrame(NODE_ROWS, "id string, name string, kind string, file string, line int")
    return nodes.select("*", F.col("line").alias("end_line"), F.lit("").alias("signature"), F.lit("").alias("doc")), edges


@query(
    "core_symbols",
    f"""WITH RECURSIVE {GRAPH_SQL}, {RANK_SQL}, r AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM pr WHERE turn = 24)
SELECT id, rank::INTEGER AS rank, round(score, 6) AS score, name, kind FROM r JOIN nodes USING (id) WHERE rank <= 5""",
)
def core_symbols(spark, d):  # noqa: ANN001, ANN201
    nodes, edges = _graph(spark, d)
    return symbol_graph.core_symbols(nodes, edges, 5, most=24, tolerance=0).select("id", "rank", F.round("score", 6).alias("score"), "name", "kind")


@query("symbol_ranks", f"WITH RECURSIVE {GRAPH_SQL}, {RANK_SQL} SELECT id, round(score, 6) AS score FROM pr WHERE turn = 24")
def symbol_ranks(spark, d):  # noqa: ANN001, ANN201
    return symbol_graph.rank_symbols(*_graph(spark, d), most=24, tolerance=0).select("id", F.round("score", 6).alias("score"))


@query(
    "symbol_diagram",
    "SELECT * FROM " + corpus.values(
        [
            (
                "graph TD\n  subgraph a\n    a[𝑓 A]\n    b[𝐶 B]\n    g[𝑓 G]\n  end\n  subgraph c\n    c[𝑚 C]\n    d[𝑓 D]\n  end\n  subgraph e\n    e[𝑣 E]\n  end\n\n  a -->|calls| b\n  a -->|calls| d\n  a -->|imports| e\n  b -->|calls| c\n  b -->|calls| d\n  c -->|calls| a\n  c -->|calls| d\n  d -->|calls| d\n  d -->|calls| e\n  e -->|calls| c\n  f -->|calls| a\n  f -->|uses| b",
            )
        ],
        "diagram"
    )
)
def symbol_diagram(spark, d):  # noqa: ANN001, ANN201
    return symbol_graph.symbol_diagram(*_listed_graph(spark))


@query(
    "related_symbols",
    f"""WITH RECURSIVE {GRAPH_SQL}, b AS (SELECT source AS x, target AS y FROM edges WHERE edge_type = 'calls' UNION SELECT target, source FROM edges
WHERE edge_type = 'calls'), r AS (SELECT 'n1' AS id, 0 AS depth UNION SELECT b.y, r.depth + 1 FROM r JOIN b ON b.x = r.id WHERE r.depth < 2)
SELECT 'n1' AS start, id, min(depth)::INTEGER AS depth FROM r WHERE id <> 'n1' GROUP BY id""",
)
def related_symbols(spark, d):  # noqa: ANN001, ANN201
    return symbol_graph.related_symbols(_graph(spark, d)[1], spark.createDataFrame([("n1",)], "id string"))


@query(
    "symbol_callers",
    """SELECT 's' || l_suppkey AS id, 'c' || o_custkey AS caller, count(*) AS calls FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey <= 5
GROUP BY ALL""",
)
def symbol_callers(spark, d):  # noqa: ANN001, ANN201
    ids = table(spark, d, "supplier").where("s_suppkey <= 5").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return symbol_graph.callers(_purchases(spark, d), ids).groupBy("id", "caller").agg(F.count("*").alias("calls"))


@query(
    "symbol_callees",
    """SELECT 'c' || o_custkey AS id, 's' || l_suppkey AS callee, count(*) AS calls FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_custkey <= 20 GROUP BY ALL""",
)
def symbol_callees(spark, d):  # noqa: ANN001, ANN201
    ids = table(spark, d, "customer").where("c_custkey <= 20").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return symbol_graph.callees(_purchases(spark, d), ids).groupBy("id", "callee").agg(F.count("*").alias("calls"))


def _purchases(spark, d):  # noqa: ANN001, ANN202
    lots = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lots.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.lit("calls").alias("edge_type"))


@query(
    "symbol_graph_changes",
    f"""WITH {GRAPH_SQL} SELECT id, CASE WHEN id = 'n1' THEN 'NEW' ELSE name END AS name, CASE WHEN id = 'n1' THEN 'class' ELSE kind END AS kind,
CASE WHEN id = 'n1' THEN 'x/y.py' ELSE file END AS file FROM nodes WHERE id <> 'n2' UNION ALL SELECT 'z', 'Z', 'function', 'x/y.py'""",
)
def symbol_graph_changes(spark, d):  # noqa: ANN001, ANN201
    nodes, _ = _graph(spark, d)
    new = spark.createDataFrame([("n1", "NEW", "class", "x/y.py"), ("z", "Z", "function", "x/y.py")], "id string, name string, kind string, file string")
    new = new.select("*", *(F.lit(1).alias(c) for c in ("line", "end_line")), *(F.lit("").alias(c) for c in ("signature", "doc")))
    gone = spark.createDataFrame([("n2",), ("none",)], "id string")
    return symbol_graph.without_symbols(symbol_graph.with_symbols(nodes, new), gone).select("id", "name", "kind", "file")


@query(
    "symbol_import_graph",
    f"""WITH {GRAPH_SQL}, m AS (SELECT id, string_split(file, '/')[1] AS module FROM nodes)
SELECT DISTINCT a.module AS src_module, b.module AS dst_module FROM edges JOIN m a ON a.id = source JOIN m b ON b.id = target WHERE edge_type = 'imports' AND a.module <> b.module""",
)
def symbol_import_graph(spark, d):  # noqa: ANN001, ANN201
    return symbol_graph.import_graph(*_graph(spark, d))


@query(
    "symbol_json_round_trip",
    f"""WITH {GRAPH_SQL} SELECT 'symbol' AS what, id AS a, name AS b, kind AS c, line::INTEGER AS line FROM nodes UNION ALL
SELECT 'edge', source, target, edge_type, line::INTEGER FROM edges""",
)
def symbol_json_round_trip(spark, d):  # noqa: ANN001, ANN201
    nodes, edges = symbol_graph.from_json(symbol_graph.to_json(*_graph(spark, d)))
    return nodes.select(
        F.lit("symbol").alias("what"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("kind").alias("c"), "line"
    ).union(edges.select(F.lit("edge"), "source", "target", "edge_type", "line"))


@query(
    "symbol_summary",
    f"""WITH {GRAPH_SQL} SELECT 'symbols' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL
SELECT 'files', count(DISTINCT file) FROM nodes UNION ALL SELECT kind, count(*) FROM nodes GROUP BY kind""",
)
def symbol_summary(spark, d):  # noqa: ANN001, ANN201
    return symbol_graph.summary(*_graph(spark, d))


@query(
    "symbol_lookups",
    f"""WITH {GRAPH_SQL}, c AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'calls' AND source <> target), t AS (SELECT max(target) AS t FROM c WHERE source = 'n1')
SELECT 'kind' AS what, id FROM nodes WHERE kind = 'function' UNION ALL SELECT 'file', id FROM nodes WHERE file = 'r1/n1.py'
UNION ALL SELECT 'id', id FROM nodes WHERE id = 'n3' UNION ALL SELECT 'uses', source || target FROM edges WHERE edge_type = 'uses'
UNION ALL SELECT 'chain', source || target FROM c, t WHERE source = 'n1' AND target = t.t
UNION ALL SELECT 'chain', a.source || a.target || b.target FROM c a JOIN c b ON b.source = a.target, t WHERE a.source = 'n1' AND a.target <> t.t AND b.target = t.t""",
)
def symbol_lookups(spark, d):  # noqa: ANN001, ANN201
    nodes, edges = _graph(spark, d)
    rows = lambda what, df, c="id": df.select(F.lit(what).alias("what"), F.col(c).alias("id"))
    last = edges.where("edge_type = 'calls' and source = 'n1' and target <> 'n1'").agg(F.max("target")).first()[0] or ""
    chains = symbol_graph.call_chain(edges, "n1", last, 2).select(F.array_join("chain", "").alias("id"))
    out = rows("kind", symbol_graph.symbols_of_kind(nodes, "function")).union(
        rows("file", symbol_graph.symbols_in(nodes, "r1/n1.py"))
    ).union(rows("id", symbol_graph.symbol(nodes, "n3")))
    uses = symbol_graph.edges_of_type(edges, "uses").select(F.concat("source", "target").alias("id"))
    return out.union(rows("uses", uses)).union(rows("chain", chains))


# ---- wiki tables ---------------------------------------------------------------------------------


def _plan(spark, d):  # noqa: ANN001, ANN202
    """Regions and nations as categories, suppliers as documents, of which those with a balance are written."""
    none = F.lit("").alias("description")
    r = table(spark, d, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), none, F.lit("").alias("parent_id"),
        F.col("r_regionkey").cast("int").alias("ord")
    )
    n = table(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), none,
        F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("int").alias("ord")
    )
    s = table(spark, d, "supplier")
    docs = s.select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"),
        F.concat(F.lit("n"), "s_nationkey").alias("category_id"), F.lit("sells").alias("purpose"),
        F.col("s_suppkey").cast("int").alias("ord")
    )
    written = s.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("doc_id"), F.concat(F.lit("# "), "s_name").alias("content"))
    return r.union(n), docs, written


@query(
    "wiki_page_list",
    """SELECT 'docs/s' || s_suppkey AS id, s_name AS title, 'category/n' || s_nationkey AS parent_id, s_suppkey::INTEGER AS ord FROM supplier
WHERE s_acctbal > 0 UNION ALL SELECT 'category/n' || n_nationkey, any_value(n_name), 'category/r' || any_value(n_regionkey), n_nationkey::INTEGER
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(*) >= 3""",
)
def wiki_page_list(spark, d):  # noqa: ANN001, ANN201
    return docmap.category_branches(*_plan(spark, d))[0].select("id", "title", "parent_id", "ord")


@query(
    "wiki_sidebar",
    """WITH w AS (SELECT * FROM supplier WHERE s_acctbal > 0), big AS (SELECT s_nationkey AS k FROM supplier GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT DISTINCT [1, r_regionkey] AS p, 0 AS depth, r_name AS title, '' AS page_id FROM w JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey UNION ALL
  SELECT DISTINCT [1, n_regionkey, 1, n_nationkey], 1, n_name, CASE WHEN n_nationkey IN (SELECT k
FROM big) THEN 'category/n' || n_nationkey ELSE '' END FROM w JOIN nation ON n_nationkey = s_nationkey UNION ALL
  SELECT [1, n_regionkey, 1, n_nationkey, 0, s_suppkey], 2, s_name, 'docs/s' || s_suppkey FROM w JOIN nation ON n_nationkey = s_nationkey)
SELECT string_agg(repeat('  ', depth) || CASE WHEN page_id = '' THEN '- **' || title || '**' ELSE '- [' || title || '](content/' || page_id || '.md)'
END, chr(10) ORDER BY p) AS text FROM e""",
)
def wiki_sidebar(spark, d):  # noqa: ANN001, ANN201
    return render.sidebar(docmap.category_branches(*_plan(spark, d))[1])


@query(
    "wiki_category_index",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS no FROM supplier)
SELECT 'category/n' || n_nationkey AS id,
md5('# ' || any_value(n_name) || chr(10) || chr(10) || '<cite>' || chr(10) || chr(10) || '**分类文档: ' || any_value(n_name) || '**' || chr(10) || chr(10)
|| '- 包含 ' || count(*) || ' 个文档' || chr(10) || chr(10) || '</cite>' || chr(10) || chr(10) || '## 目录' || chr(10) || chr(10)
  || string_agg(no || '. [' || s_name || '](#s' || s_suppkey || ')', chr(10) ORDER BY no) || chr(10) || chr(10) || '## 文档列表' || chr(10) || chr(10)
  || string_agg('- [' || CASE WHEN s_acctbal > 0 THEN '✓' ELSE '○' END || '] [' || s_name || '](docs/s' || s_suppkey || ') — sells', chr(10)
ORDER BY no)) AS content FROM s JOIN nation ON n_nationkey = s_nationkey GROUP BY n_nationkey HAVING count(*) >= 3""",
)
def wiki_category_index(spark, d):  # noqa: ANN001, ANN201
    return docmap.category_branches(*_plan(spark, d))[0].where("id like 'category/%'").select("id", F.md5("content").alias("content"))


@query(
    "metadata_round_trip",
    """SELECT 'catalog' AS what, n_name AS name, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'item', s_name, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'relation', 's' || s_suppkey, 'n' || s_nationkey FROM supplier""",
)
def metadata_round_trip(spark, d):  # noqa: ANN001, ANN201
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    made = metadata.catalogs(n.select(F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id")))
    listed = metadata.items(
        s.select(
            F.concat(F.lit("n"), "s_nationkey").alias("catalog_id"), F.col("s_name").alias("title"), F.lit("sells").alias("description"),
            F.lit("").alias("parent_id")
        )
    )
    pairs = s.select(F.concat(F.lit("n"), "s_nationkey").alias("source_id"), F.concat(F.lit("s"), "s_suppkey").alias("target_id"), F.lit("PARENT_CHILD").alias("kind"))
    item = F.lit("WIKI_ITEM")
    links = metadata.relations(pairs).select(
        F.col("rel_id").cast("long").alias("id"), "source_id", "target_id", item.alias("source_type"), item.alias("target_type"),
        F.col("kind").alias("relationship_type"), F.lit("").alias("extra")
    )
    back = metadata.read_document(metadata.document("trade", made, listed, links))
    rows = lambda what, df, name, parent: df.select(F.lit(what).alias("what"), F.col(name).alias("name"), F.col(parent).alias("parent"))
    return rows("catalog", back["catalogs"], "name", "parent_id").union(rows("item", back["items"], "title", "catalog_id")).union(
        rows("relation", back["relations"], "target_id", "source_id")
    )


@query(
    "metadata_lookups",
    f"""WITH t AS (SELECT 'tree' AS what, r_name AS name FROM region UNION ALL SELECT 'tree', r_name || '/' || n_name FROM nation
JOIN region ON r_regionkey = n_regionkey)
SELECT * FROM t UNION ALL SELECT 'title', min(s_name) FROM supplier UNION ALL SELECT 'in catalog', s_name FROM supplier WHERE s_nationkey = 1
UNION ALL SELECT 'below', s_name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'next relation', (count(*) + 1)::VARCHAR FROM supplier""",
)
def metadata_lookups(spark, d):  # noqa: ANN001, ANN201
    r, n, s = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    top = r.select(F.col("r_name").alias("name"), F.lit("").alias("parent_id"))
    below = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), metadata.key_of(F.lit(""), F.col("r_name")).alias("parent_id"))
    tree = metadata.catalog_tree(metadata.catalogs(top.union(below)))
    parent = F.when(F.col("s_acctbal") > 0, "rich").otherwise("")
    listed = metadata.items(
        s.select(
            F.concat(F.lit("n"), "s_nationkey").alias("catalog_id"), F.col("s_name").alias("title"), F.lit("").alias("description"),
            parent.alias("parent_id")
        )
    )
    pairs = s.select(F.concat(F.lit("n"), "s_nationkey").alias("source_id"), F.concat(F.lit("s"), "s_suppkey").alias("target_id"), F.lit("PARENT_CHILD").alias("kind"))
    following = metadata.next_relation_id(metadata.relations(pairs).withColumnRenamed("rel_id", "id"))
    first = s.agg(F.min("s_name")).first()[0] or ""
    rows = lambda what, df, c="title": df.select(F.lit(what).alias("what"), F.col(c).alias("name"))
    out = rows("tree", tree, "path").union(rows("title", metadata.item_by_title(listed, first)))
    out = out.union(rows("in catalog", metadata.items_of(listed, "n1"))).union(rows("below", metadata.child_items(listed, "rich")))
    return out.union(rows("next relation", spark.createDataFrame([(str(following),)], "title string")))


@query(
    "wiki_single_page",
    """WITH p AS (SELECT r_regionkey AS ord, 'r' || r_regionkey AS id, r_name AS title FROM region)
SELECT '<!doctype html><html><head><meta charset="utf-8"><title>Regions &amp; more</title></head><body><nav>'
  || string_agg('<a href="#' || id || '">' || title || '</a>', chr(10) ORDER BY ord) || '</nav><main>'
  || string_agg('<section id="' || id || '"><h1>' || title || '</h1>' || chr(10) || '<p>about <strong>' || title || '</strong></p>' || chr(10) ||
'</section>', chr(10) ORDER BY ord)
  || '</main></body></html>' AS html FROM p""",
)
def wiki_single_page(spark, d):  # noqa: ANN001, ANN201
    content = F.concat(F.lit("about **"), "r_name", F.lit("**"))
    pages = table(spark, d, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), content.alias("content"),
        F.col("r_regionkey").alias("ord")
    )
    return sinks.single_page(pages, "Regions & more")


@query(
    "relation_numbers",
    """SELECT 'c' || o_custkey AS source_id, 's' || l_suppkey AS target_id, row_number() OVER (ORDER BY 'c' || o_custkey, 's' || l_suppkey) AS rel_id
FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""",
)
def relation_numbers(spark, d):  # noqa: ANN001, ANN201
    pairs = _purchases(spark, d).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("BUYS").alias("kind"))
    return metadata.relations(pairs).select("source_id", "target_id", F.col("rel_id").cast("long").alias("rel_id"))


@query(
    "page_relations",
    """SELECT 'n' || s_nationkey AS source_id, 's' || s_suppkey AS target_id,
'Wiki parent-child relationship: category/n' || s_nationkey || ' -> docs/s' || s_suppkey AS extra FROM supplier WHERE s_acctbal > 0""",
)
def page_relations(spark, d):  # noqa: ANN001, ANN201
    pages = docmap.category_branches(*_plan(spark, d))[0].where("id like 'docs/%'")
    return metadata.page_relations(pages).select("source_id", "target_id", "extra")


@query("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_pending(spark, d):  # noqa: ANN001, ANN201
    records = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    return state.pending(table(spark, d, "documents").select("doc_id"), records, "resume")


@query(
    "cache_get",
    """WITH l AS (SELECT user_id AS key, props AS value, ts, event_type, row_number() OVER (PARTITION BY user_id
ORDER BY ts DESC, event_type DESC, props DESC) AS rn FROM events) SELECT key, value FROM l WHERE rn = 1 AND key IN (SELECT c_custkey
FROM customer) AND event_type <> 'delete' AND epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts)) <= 604800""",
)
def cache_get(spark, d):  # noqa: ANN001, ANN201
    log = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("op"),
        F.col("props").alias("value")
    )
    return state.cached(log, table(spark, d, "customer").select(F.col("c_custkey").alias("key")), F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query(
    "generation_outcome",
    """SELECT count(*) FILTER (WHERE text NOT LIKE '%Warning%' AND doc_id % 5 <> 0) AS successful,
count(*) FILTER (WHERE text LIKE '%Warning%' OR doc_id % 5 = 0) AS failed FROM documents""",
)
def generation_outcome(spark, d):  # noqa: ANN001, ANN201
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Warning: "), "text")).otherwise(F.col("text"))
    return state.outcome(table(spark, d, "documents").select(text.alias("content")))


@query(
    "usage_totals",
    """SELECT count(*) AS calls, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(user_id)::BIGINT AS completion_tokens, round(sum(value), 2) AS cost
FROM events""",
)
def usage_totals(spark, d):  # noqa: ANN001, ANN201
    calls = table(spark, d, "events").select((F.col("event_id") % 100).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"), F.col("value").alias("cost"))
    return state.usage(calls).withColumn("cost", F.round("cost", 2))


@query("wanted_files", "SELECT 'd' || doc_id AS id, 'src/m' || doc_id % 7 || '.py' AS path FROM documents WHERE doc_id % 7 < 5 AND doc_id % 3 <> 0")
def wanted_files(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("src/m"), F.col("doc_id") % 7, F.lit(".py")).alias("path"), "doc_id"
    )
    answers = docs.select("id", F.concat(F.lit("please show me "), "path").alias("answer"))
    known = spark.range(5).select(F.concat(F.lit("src/m"), "id", F.lit(".py")).alias("path"))
    return generation.wanted_files(answers, known, docs.where("doc_id % 3 = 0").select("id", "path"))


IMPORT_KINDS = [("import", "import"), ("dynamic", "dynamic"), ("mod", "import"), ("sql_file", "sql_file"), ("", "import")]


@query("import_kinds", f"SELECT doc_id, x.kind, x.known FROM {corpus.dealt_sql([(i, *r) for i, r in enumerate(IMPORT_KINDS)], 'kind, known', len(IMPORT_KINDS))}")
def import_kinds(spark, d):  # noqa: ANN001, ANN201
    rows = corpus.dealt(table(spark, d, "documents"), [r[:1] for r in IMPORT_KINDS], ["kind"])
    return rows.select("doc_id", "kind", f.known_kind(F.col("kind")).alias("known"))


SHOWN_IDS = [("guide/Setup/x", "指南/安装配置/x"), ("API", "API参考"), ("none", "none"), ("core/PayPal", "核心组件/PayPal")]


@query("chinese_ids", f"SELECT x.id || '/' || doc_id AS id, x.shown || '/' || doc_id AS shown FROM {corpus.dealt_sql([(i, *r) for i, r in enumerate(SHOWN_IDS)], 'id, shown', len(SHOWN_IDS))}")
def chinese_ids(spark, d):  # noqa: ANN001, ANN201
    rows = corpus.dealt(table(spark, d, "documents"), [r[:1] for r in SHOWN_IDS], ["id"]).select(F.concat("id", F.lit("/"), "doc_id").alias("id"))
    return rows.select("id", f.chinese_id(F.col("id")).alias("shown"))


@query(
    "module_pages",
    """SELECT 'src' || i AS name, '# src' || i || chr(10) || chr(10) || '<cite>' || chr(10) || chr(10) || '**本文引用的文件**' || chr(10) || chr(10) || '- [src' ||
i || '/a.py](file://src' || i || '/a.py)' || chr(10) || '</cite>' || chr(10) || chr(10) || '> does ' || i || chr(10) || chr(10) || '## Files' ||
chr(10) || chr(10) || '### `src' || i || '/a.py`' || chr(10) || chr(10) || 'main' || chr(10) || chr(10) || '**Key Symbols:**' || chr(10) || chr(10) ||
'- `go` (function) (line 3) — runs' || chr(10) || '- `X` (class)' || chr(10) || chr(10) || '- [src' || i || '/a.py:3-3](file://src' || i ||
'/a.py#3-3)' || chr(10) || '- [src' || i || '/a.py](file://src' || i || '/a.py)' || chr(10) || chr(10) || '## Key Concepts' || chr(10) || chr(10) ||
'- **Idea**: why' || chr(10) || chr(10) || '## Internal Relationships' || chr(10) || chr(10) || '- `a` → `b`: calls' || chr(10) AS page
FROM range(3) AS t(i)""",
)
def module_pages(spark, d):  # noqa: ANN001, ANN201
    symbols_ = F.array(
        *(
            F.struct(
                F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(x).alias("line"), F.lit(t).alias("description")
            ) for n, k, x, t in (("go", "function", 3, "runs"), ("X", "class", 0, ""))
        )
    )
    path = F.concat(F.lit("src"), "id", F.lit("/a.py"))
    files = F.array(F.struct(path.alias("path"), F.lit("main").alias("purpose"), symbols_.alias("key_symbols")))
    links = F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("calls").alias("description")))
    ideas = F.array(F.struct(F.lit("Idea").alias("name"), F.lit("why").alias("explanation")))
    rows = spark.range(3).select(
        F.concat(F.lit("src"), "id").alias("name"), F.concat(F.lit("does "), "id").alias("purpose"), F.lit("").alias("description"),
        files.alias("files"), links.alias("relationships"), ideas.alias("key_concepts")
    )
    return rows.select("name", wiki_pages.module_page(F.struct(*rows.columns)).alias("page"))


# ---- rendering -----------------------------------------------------------------------------------


@query(
    "mermaid_edges",
    f"""WITH {LINKS_SQL} SELECT DISTINCT source_file AS src, target_file AS dst, '  ' || regexp_replace(source_file, '[^a-zA-Z0-9_]', '_',
'g') || ' --> ' || regexp_replace(target_file, '[^a-zA-Z0-9_]', '_', 'g') AS line FROM links WHERE NOT is_external""",
)
def mermaid_edges(spark, d):  # noqa: ANN001, ANN201
    return render.edge_lines(_links(spark, d).where("not is_external").select(F.col("source_file").alias("src"), F.col("target_file").alias("dst")))


@query(
    "module_diagram",
    f"""WITH {TRADE_SQL}, {FILES_SQL}, deps AS (SELECT DISTINCT 'r' || a.n_regionkey AS src, 'r' || b.n_regionkey AS dst FROM trade t
JOIN nation a ON a.n_nationkey = t.src JOIN nation b ON b.n_nationkey = t.dst WHERE a.n_regionkey <> b.n_regionkey),
m AS (SELECT string_split(path, '/')[1] AS module, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, module LIMIT 12)
SELECT 'graph TD' || chr(10) || (SELECT string_agg('  ' || module || '[(' || module || ' - ' || n || ' files)]', chr(10) ORDER BY n DESC, module)
FROM m) || chr(10) || chr(10) || (SELECT string_agg('  ' || src || ' --> ' || dst, chr(10) ORDER BY src, dst) FROM deps) AS diagram""",
)
def module_diagram(spark, d):  # noqa: ANN001, ANN201
    return render.module_diagram(_files(spark, d), module_dependencies(spark, d))


HTML = [
    (
        1,
        "<h1>Title &amp; more</h1>\n<br>\n<p>text <strong>bold</strong> and <code>code</code> &lt;tag&gt;</p>\n<li>item</li>\n<li>first</li>\n<blockquote>quote</blockquote>"
    ),
    (2, '<pre><code class="language-python">x = &quot;&lt;a&gt;&quot;</code></pre>\n<p>after</p>'), (3, '<div class="mermaid">graph TD</div>'),
    (4, '<h2>Two <a href="http://a?b=1&amp;c=2">link</a></h2>\n<h3>Three</h3>\n<pre><code class="language-text">plain</code></pre>'),
]


@query("markdown_to_html", f"SELECT doc_id, x.html || chr(10) || '<h1>' || doc_id || '</h1>' AS html FROM {corpus.dealt_sql([(i, h) for i, (_, h) in enumerate(HTML)], 'html', len(HTML))}")
def markdown_to_html(spark, d):  # noqa: ANN001, ANN201
    rows = corpus.dealt(table(spark, d, "documents"), [(m.removesuffix("\n```open\nlost"),) for _, m in corpus.MARKDOWN], ["markdown"])
    return rows.select("doc_id", render.markdown_to_html(F.concat("markdown", F.lit("\n# "), "doc_id")).alias("html"))


@query(
    "category_pages",
    """WITH n AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS no FROM nation)
SELECT 'r' || r_regionkey AS category_id, any_value(r_name) AS title, count(*) AS n_docs,
'# ' || any_value(r_name) || chr(10) || chr(10) || string_agg(no || '. **' || n_name || '**: nation ' || n_nationkey, chr(10) ORDER BY no) AS content
FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey HAVING count(*) >= 3""",
)
def category_pages(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"))
    n = table(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"),
        F.concat(F.lit("r"), "n_regionkey").alias("category_id"), F.concat(F.lit("nation "), "n_nationkey").alias("purpose"),
        F.col("n_nationkey").alias("ord")
    )
    return render.category_pages(r, n)


@query(
    "sidebar",
    """SELECT '- **Alone**
- **Docs**
  - **API**
    - [Auth](content/auth.md)
      - [Tokens](content/tokens.md)
  - **Guide**' AS text""",
)
def sidebar(spark, d):  # noqa: ANN001, ANN201
    tree = docmap.tree_paths(spark.createDataFrame(corpus.CATEGORIES, "id string, parent_id string, title string"))
    return render.sidebar(
        tree.select(
            F.col("path").alias("sort_path"), "depth", F.element_at(F.split("path", "/"), -1).alias("title"),
            F.when(F.col("depth") > 1, F.col("id")).otherwise("").alias("page_id")
        )
    )


@query(
    "requested_files",
    """WITH b AS (SELECT doc_id, regexp_replace(md5(text), '[^a-z]', '', 'g') AS w FROM documents)
SELECT doc_id, ['src/' || w || '.py', 'lib/' || w || '.ts'] AS files FROM b WHERE w <> ''""",
)
def requested_files(spark, d):  # noqa: ANN001, ANN201
    """Files named after the letters of each text's hash."""
    w = F.regexp_replace(F.md5("text"), "[^a-z]", "")
    answer = F.concat(F.lit("More, please.\n## Files I Need\n- `x y`\n- src/"), w, F.lit(".py\n## Next\nplease show me lib\\"), w, F.lit(".ts and src/"), w, F.lit(".py"))
    rows = table(spark, d, "documents").where(w != "").select("doc_id", generation.requested_files(answer).alias("files"))
    return rows.select("doc_id", F.sort_array("files", asc=False).alias("files"))


@query("project_type", "SELECT 'full-stack' AS project_type")
def project_type(spark, d):  # noqa: ANN001, ANN201
    extra = spark.createDataFrame([("package.json", "json", "{}")], "path string, language string, content string")
    return generation.project_type(corpus.listed_files(spark).union(extra).withColumn("is_config", f.is_config(F.col("path"))))


@query(
    "missing_dependencies",
    f"""WITH {LINKS_SQL}, m AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages WHERE page_id % 2 = 0)
SELECT target_file, min(source_file) AS source_file FROM links WHERE source_file IN (SELECT path FROM m) AND target_file NOT IN (SELECT path FROM m) GROUP BY target_file""",
)
def missing_dependencies(spark, d):  # noqa: ANN001, ANN201
    """What pages of even number link to outside of them."""
    module = table(spark, d, "pages").where("page_id % 2 = 0").select(sources.page_path(F.col("url")).alias("path")).distinct()
    return docmap.missing_dependencies(_links(spark, d), module)



@query(
    "module_prompts",
    f"""WITH {FILES_SQL}, r AS (SELECT string_split(path, '/')[1] AS id, path, CASE WHEN length(content) > 2048 THEN substr(content, 1,
2048) || chr(10) || '... (truncated)' ELSE content END AS shown FROM files),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS place, count(*) OVER (PARTITION BY id) AS n_files FROM r)
SELECT id, any_value(n_files) AS n_files, md5(string_agg('--- ' || path || chr(10) || shown, chr(10) || chr(10) ORDER BY path)) AS body FROM n
WHERE place <= 20 GROUP BY id""",
)
def module_prompts(spark, d):  # noqa: ANN001, ANN201
    rows = generation.module_prompts(_files(spark, d), f.module_name)
    body = F.regexp_extract("prompt", r"(?s)## Files\n(.*)\n\n## Answer\n", 1)
    return rows.select("id", "n_files", F.md5(body).alias("body"))


@query(
    "metadata_from_symbols",
    """SELECT n_name AS title, 'nation: ' || n_name AS description, substr(sha256('' || chr(31) || 'r' || n_regionkey), 1, 32) AS catalog_id FROM nation""",
)
def metadata_from_symbols(spark, d):  # noqa: ANN001, ANN201
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"),
        F.concat(F.lit("r"), "n_regionkey", F.lit("/x")).alias("file")
    )
    return metadata.from_symbols(n)[1].select("title", "description", "catalog_id")


@query(
    "retry_queue",
    """SELECT doc_id, 'failed' AS status, (doc_id % 3 + 1)::INTEGER AS retry_count FROM labels WHERE quality = 0 AND doc_id % 3 + 1 <= 2""",
)
def retry_queue(spark, d):  # noqa: ANN001, ANN201
    labels = table(spark, d, "labels")
    before = labels.select("doc_id", F.lit("pending").alias("status"), (F.col("doc_id") % 3).cast("int").alias("retry_count"))
    return state.to_retry(state.after_attempt(before, labels.select("doc_id", (F.col("quality") == 1).alias("ok")))).select("doc_id", "status", "retry_count")


@query("streaming_file_ingest", "SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def streaming_file_ingest(spark, d):  # noqa: ANN001, ANN201
    import tempfile

    from codequarry.streaming.ingest import counts_by_language, stream_table

    found: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        found.append(durable(batch))

    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    import uuid

    stream = counts_by_language(stream_table(spark, d, "documents"))
    done = stream.writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", f"{where}/stream-{uuid.uuid4().hex}"
    ).trigger(availableNow=True).start()
    done.awaitTermination()
    return found[-1]

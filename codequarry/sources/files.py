"""Trees of source files as a table, and the given tables in the same form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import files as f

MAX_BYTES, MAX_FILES, PREVIEW_LINES, LARGE_CHARS, LARGE_PREVIEW_LINES = 200 * 1024, 1000, 80, 4000, 200


def described(files: DataFrame, preview_lines: int = PREVIEW_LINES) -> DataFrame:
    """files(path, size, content) with language, lines, preview and roles."""
    path, content = F.col("path"), F.col("content")
    whole = f.is_config(path) | f.is_entrypoint(path)
    shown = F.when(F.length(content) > LARGE_CHARS, f.preview(content, LARGE_PREVIEW_LINES)).when(whole, content).otherwise(f.preview(content, preview_lines))
    return files.select(
        "path", "size", f.language(path).alias("language"), f.line_count(content).alias("lines"), shown.alias("preview"), "content",
        f.is_config(path).alias("is_config"), f.is_entrypoint(path).alias("is_entrypoint")
    )


def wanted(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of files(path, size) worth reading: no skipped folder or suffix, not empty, and not too large unless code."""
    path = F.col("path")
    return files.where(~f.in_skipped_dir(path) & ~f.has_skipped_suffix(path) & (F.col("size") > 0) & ((F.col("size") <= max_bytes) | f.is_code(path)))


def in_scan_order(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """The first `most` of files(path): configuration, entry points, then the rest, each by path. The limit is a property of a scan."""
    return files.orderBy(f.scan_rank(F.col("path")), "path").limit(most)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size, uri of the files under root; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = "^(file:)?/*" + re.escape(root.rstrip("/").removeprefix("file:").lstrip("/") + "/")
    return rows.select(F.regexp_replace("path", F.lit(base), F.lit("")).alias("path"), F.col("length").alias("size"), F.col("path").alias("uri"))


def scan_directory(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES, preview_lines: int = PREVIEW_LINES) -> DataFrame:
    """Text files under root with the columns of described(). Names and sizes are filtered on a listing without contents; the first
    files in scan order, twice as many as are asked for, are then read; binary (a zero byte among the first 1024) and minified
    ones are left out, invalid UTF-8 is replaced."""
    found = in_scan_order(wanted(listed(spark, root), max_bytes), 2 * max_files).collect()  # a scan's own limit
    if not found:
        return described(spark.createDataFrame([], "path string, size long, content string"), preview_lines)
    names = spark.createDataFrame([(r.uri, r.path, r.size) for r in found], "uri string, path string, size long")
    escaped = [re.sub(r"([*?{}\[\]\\,])", r"\\\1", r.uri) for r in found]
    raw = spark.read.format("binaryFile").load(escaped).select(F.col("path").alias("uri"), F.col("content").alias("raw"))
    text = raw.where(F.position(F.lit(b"\x00"), F.substring("raw", 1, 1024)) == 0)
    files = text.join(F.broadcast(names), "uri").select("path", "size", F.make_valid_utf8(F.col("raw").cast("string")).alias("content"))
    return in_scan_order(described(files.where(~f.looks_minified(F.col("path"), F.col("content"))), preview_lines), max_files)


def project_name(files: DataFrame, fallback: str) -> DataFrame:
    """name: what the first manifest in scan order states, or fallback."""
    stated = files.select("path", f.stated_name(F.col("path"), F.col("content")).alias("name")).where("name is not null")
    first = stated.agg(F.min(F.struct(f.scan_rank(F.col("path")).alias("r"), "path", "name")).alias("x"))
    return first.select(F.coalesce("x.name", F.lit(fallback)).alias("name"))


def document_files(documents: DataFrame) -> DataFrame:
    """documents as files: path, language, lines, size, content."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        f.document_path(F.col("source"), F.col("lang"), F.col("doc_id")).alias("path"), F.col("lang").alias("language"),
        f.line_count(text).alias("lines"), F.length(text).cast("long").alias("size"), text.alias("content")
    )


def page_path(url: Column) -> Column:
    """The path of an address, without host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")


def page_targets(html: Column) -> Column:
    """Addresses that a page links to, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def page_names(path: Column) -> Column:
    """What links to a page may name: its path, and its first folder."""
    return F.array(path, F.regexp_extract(path, "^/[^/]+", 0))


def page_links(pages: DataFrame) -> DataFrame:
    """source_file, target_module, target_file, is_external: the links of pages(page_id, url, html), pages being named by the path of their
    address. A link to the path of a known page, or to the first folder of one, is internal."""
    links = pages.select(page_path(F.col("url")).alias("source_file"), F.explode(page_targets(F.col("html"))).alias("target_module"))
    known = pages.select(F.explode(page_names(page_path(F.col("url")))).alias("target_file")).distinct()
    out = links.withColumn("k", page_path(F.col("target_module"))).join(known, F.col("k") == F.col("target_file"), "left")
    return out.select("source_file", "target_module", "target_file", F.col("target_file").isNull().alias("is_external"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")

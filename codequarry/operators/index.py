"""Dependency index: lookups, reverse lookups and statistics over files and resolved imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.files import module_name, top_folder


def imports_of(imports: DataFrame, path: str) -> DataFrame:
    return imports.where(F.col("source_file") == path)


def importers_of(imports: DataFrame, path: str) -> DataFrame:
    """Import rows that point at path; a file that imports it twice stands twice."""
    return imports.where(F.col("target_file") == path)


def users_of(imports: DataFrame, module: str) -> DataFrame:
    """Files that use an external module."""
    return imports.where(F.col("is_external") & (F.col("target_module") == module)).select("source_file").distinct()


def importer_counts(imports: DataFrame) -> DataFrame:
    """target_file, n_imports, n_files: how many import rows and files point at each file."""
    inside = imports.where(~F.col("is_external") & F.col("target_file").isNotNull())
    return inside.groupBy("target_file").agg(F.count("*").alias("n_imports"), F.count_distinct("source_file").alias("n_files"))


def external_index(imports: DataFrame) -> DataFrame:
    """target_module, files: the files that use each external module, as an array; meant for looking modules up, users_of() does for one."""
    return imports.where("is_external").groupBy("target_module").agg(F.sort_array(F.collect_set("source_file")).alias("files"))


def indexes(files: DataFrame, imports: DataFrame) -> DataFrame:
    """index, key, path: the files of each language and module of files(path, language), and those that use each external module, a row a
    file. Written partitioned by index and key, a lookup reads one folder; no key's files are gathered."""
    language = files.select(F.lit("language").alias("index"), F.col("language").alias("key"), "path")
    module = files.select(F.lit("module"), top_folder(F.col("path")), "path")
    external = imports.where("is_external").select(F.lit("external"), "target_module", "source_file").distinct()
    return language.union(module).union(external)


def external_modules(imports: DataFrame) -> DataFrame:
    return imports.where("is_external").select("target_module").distinct()


def entry_points(files: DataFrame, imports: DataFrame, most: int = 1) -> DataFrame:
    """Paths at which at most `most` import rows point, loops and repeats included."""
    pointed = imports.where(F.col("target_file").isNotNull()).groupBy(F.col("target_file").alias("path")).agg(F.count("*").alias("n"))
    return files.select("path").join(pointed, "path", "left").where(F.coalesce("n", F.lit(0)) <= most).select("path", F.coalesce("n", F.lit(0)).alias("n_imports"))


def module_dependencies(imports: DataFrame, module_of: Column = None) -> DataFrame:  # noqa: RUF013
    """Different modules joined by an internal, resolved import."""
    named = module_of or module_name
    inside = imports.where(~F.col("is_external") & F.col("target_file").isNotNull())
    return inside.select(named(F.col("source_file")).alias("src_module"), named(F.col("target_file")).alias("dst_module")).where("src_module <> dst_module").distinct()


def statistics(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: files, imports, external modules, folders and languages, and the first 50 external modules in order. Distinct values are
    found by grouping first, and only the first 50 are gathered."""
    outside = external_modules(imports)
    first = outside.orderBy("target_module").limit(50).agg(F.sort_array(F.collect_list("target_module")).alias("top_external"))
    return (
        files.agg(
            F.count("*").alias("total_files"), F.count_distinct(top_folder(F.col("path"))).alias("module_count"),
            F.count_distinct("language").alias("language_count")
        )
        .crossJoin(imports.agg(F.count("*").alias("total_imports"))).crossJoin(outside.agg(F.count("*").alias("external_dependencies"))).crossJoin(first)
    )


def language_statistics(files: DataFrame, imports: DataFrame) -> DataFrame:
    per_file = imports.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("n"))
    return files.select("path", "language").join(per_file, "path", "left").groupBy("language").agg(
        F.count("*").alias("file_count"), F.sum(F.coalesce("n", F.lit(0))).alias("total_imports"), F.round(
            F.avg(F.coalesce("n", F.lit(0))), 6
        ).alias("avg_imports_per_file")
    )


def module_statistics(files: DataFrame, imports: DataFrame) -> DataFrame:
    inside = F.count_if(~F.col("is_external")).alias("inside")
    per_file = imports.groupBy(F.col("source_file").alias("path")).agg(inside, F.count_if("is_external").alias("outside"))
    return files.select("path", "lines").join(per_file, "path", "left").groupBy(top_folder(F.col("path")).alias("module")).agg(
        F.count("*").alias("file_count"), F.sum("lines").alias("total_lines"), F.sum(F.coalesce("inside", F.lit(0))).alias("internal_imports"), F.sum(
            F.coalesce("outside", F.lit(0))
        ).alias("external_imports")
    )


def search_files(files: DataFrame, query: str, field: str = "path", language: str | None = None, module: str | None = None) -> DataFrame:
    """Files whose path contains query in any case, of a language and folder if given; any other field finds nothing."""
    found = files.where(F.lower("path").contains(query.lower()) if field == "path" else F.lit(False))
    if language:
        found = found.where(F.col("language") == language)
    return found.where(top_folder(F.col("path")) == module) if module else found


def language_breakdown(files: DataFrame, top: int = 10) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.col("n_files").desc(), "language").limit(top)

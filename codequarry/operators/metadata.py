"""Wiki metadata as tables: catalogs, items and relations with keys that depend on their names alone, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.files import first_part
from codequarry.operators.docmap import tree_paths
from codequarry.session import numbered

CATALOGS = "id string, name string, parent_id string"
ITEMS = "id string, catalog_id string, title string, description string, parent_id string"
RELATIONS = "id long, source_id string, target_id string, source_type string, target_type string, relationship_type string, extra string"


def key_of(*parts: Column) -> Column:
    """Stable identifier of a name and its parent; equal ones meet, so creating twice is getting."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def catalogs(names: DataFrame) -> DataFrame:
    """id, name, parent_id for distinct names(name, parent_id)."""
    return names.select("name", F.coalesce("parent_id", F.lit("")).alias("parent_id")).distinct().withColumn("id", key_of(F.col("parent_id"), F.col("name")))


def items(rows: DataFrame) -> DataFrame:
    """id, catalog_id, title, description, parent_id for rows(catalog_id, title, description, parent_id)."""
    made = rows.select("catalog_id", "title", "description", F.coalesce("parent_id", F.lit("")).alias("parent_id")).distinct()
    return made.select(key_of(F.col("catalog_id"), F.col("parent_id"), F.col("title")).alias("id"), "catalog_id", "title", "description", "parent_id")


def from_symbols(symbols: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(catalogs, items): the first `most` symbols(ord, name, kind, file) by ord as items of a catalog for each top folder."""
    module = first_part(F.when(F.contains(F.col("file"), F.lit("/")), F.col("file")).otherwise(F.lit("")))
    first = symbols.orderBy("ord").limit(most).withColumn("module", module)
    made = catalogs(first.select(F.col("module").alias("name"), F.lit("").alias("parent_id")))
    rows = first.select(
        key_of(F.col("module"), F.col("name"), F.col("ord").cast("string")).alias("id"), F.col("name").alias("title"),
        F.concat_ws(": ", "kind", "name").alias("description"), key_of(F.lit(""), F.col("module")).alias("catalog_id"),
    )
    return made, rows


def relations(pairs: DataFrame) -> DataFrame:
    """rel_id, source_id, target_id, kind for pairs(source_id, target_id, kind): numbered in order, one row a pair."""
    unique = pairs.select("source_id", "target_id", "kind").distinct()
    return numbered(unique, ["source_id", "target_id", "kind"], "rel_id")


def page_relations(pages: DataFrame) -> DataFrame:
    """Relations between pages(id, parent_id) and their parents, for a wiki without metadata of its own."""
    bare = lambda c: F.replace(F.replace(F.col(c), F.lit("category/")), F.lit("docs/"))
    rows = pages.where("coalesce(parent_id, '') <> ''").select(
        bare("parent_id").alias("source_id"), bare("id").alias("target_id"), F.lit("WIKI_ITEM").alias("source_type"), F.lit("WIKI_ITEM").alias("target_type"),
        F.lit("PARENT_CHILD").alias("relationship_type"), F.concat(F.lit("Wiki parent-child relationship: "), "parent_id", F.lit(" -> "), "id").alias("extra"),
    )
    return numbered(rows, ["source_id", "target_id", "extra"], "id").select(*_names(RELATIONS))


def document(project: str, made: DataFrame, listed: DataFrame, links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """json: one row with the catalogs, items, relations and, with pages(id, title), the documents of a project's wiki."""
    whole = lambda df, schema, name: df.agg(F.sort_array(F.collect_list(F.struct(*_names(schema)))).alias(name))
    parts = whole(links, RELATIONS, "knowledge_relations").crossJoin(whole(made, CATALOGS, "wiki_catalogs")).crossJoin(whole(listed, ITEMS, "wiki_items"))
    overview = F.struct(F.lit(f"# {project}\n\nProject documentation.").alias("content")).alias("wiki_overview")
    repo = F.struct(
        key_of(F.lit(project)).alias("id"), F.lit(project).alias("name"), F.lit("completed").alias("progress_status"),
        F.lit("COMPLETED").alias("wiki_present_status")
    ).alias("wiki_repo")
    columns = ["knowledge_relations", "wiki_catalogs", "wiki_items", overview, repo]
    if pages is not None:
        parts = parts.crossJoin(whole(pages.where("id not in ('index', 'dependencies')"), "id string, title string", "docs"))
        columns.append("docs")
    return parts.select(F.to_json(F.struct(*columns)).alias("json"))


def read_document(text: DataFrame) -> dict[str, DataFrame]:
    """catalogs, items and relations of text(json) as document() writes it."""
    shape = lambda schema: ",".join(c.replace(" ", ":", 1) for c in schema.split(", "))
    whole = text.select(
        F.from_json(
            "json",
            f"wiki_catalogs array<struct<{shape(CATALOGS)}>>, wiki_items array<struct<{shape(ITEMS)}>>, knowledge_relations array<struct<{shape(RELATIONS)}>>"
        ).alias("d")
    )
    return {name: whole.select(F.inline(f"d.{part}")) for name, part in (("catalogs", "wiki_catalogs"), ("items", "wiki_items"), ("relations", "knowledge_relations"))}


def next_relation_id(links: DataFrame) -> int:
    """The number that the next relation gets."""
    return (links.agg(F.max("id")).first()[0] or 0) + 1


def item_by_title(listed: DataFrame, title: str) -> DataFrame:
    """The item with that title and the smallest id."""
    return listed.where(F.col("title") == title).orderBy("id").limit(1)


def items_of(listed: DataFrame, catalog_id: str) -> DataFrame:
    return listed.where(F.col("catalog_id") == catalog_id)


def child_items(listed: DataFrame, parent_id: str) -> DataFrame:
    return listed.where(F.col("parent_id") == parent_id)


def catalog_tree(made: DataFrame) -> DataFrame:
    """id, depth, path of catalogs(id, name, parent_id)."""
    return tree_paths(made.select("id", "parent_id", F.col("name").alias("title")))


def summary(made: DataFrame, listed: DataFrame, links: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(made, "catalogs").crossJoin(count(listed, "items")).crossJoin(count(links, "relations"))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]

"""The graph of symbols: a table of symbols and one of edges between them, its lookups, ranking, diagram, and its JSON form.

symbols have id, name, kind, file, line, end_line, signature, doc; edges have source, target, edge_type, line, raw. Lookups are filters
or joins on ids; rows of repeated edges stay repeated, as a symbol may call another several times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.files import edge_label, kind_icon, module_name, symbol_diagram_id
from codequarry.operators import graph
from codequarry.operators.symbols import kind_counts
from codequarry.schemas import SYMBOL_EDGES, SYMBOL_ROWS

SYMBOLS = f"{SYMBOL_ROWS}, file string"


def with_symbols(symbols: DataFrame, new: DataFrame) -> DataFrame:
    """symbols with new ones put in; those with a known id take its place."""
    return symbols.join(new.select("id"), "id", "left_anti").unionByName(new.select(symbols.columns))


def without_symbols(symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """symbols without the ids of gone(id). Their edges stay in the table of edges; lookups by known symbols pass them over."""
    return symbols.join(gone.select("id"), "id", "left_anti")


def symbol(symbols: DataFrame, symbol_id: str) -> DataFrame:
    return symbols.where(F.col("id") == symbol_id)


def symbols_in(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file") == file)


def symbols_of_kind(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.col("kind") == kind)


def edges_of_type(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type)


def callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, caller: a row for each call of one of ids(id)."""
    calls = edges_of_type(edges, "calls").select(F.col("target").alias("id"), F.col("source").alias("caller"))
    return calls.join(ids.select("id").distinct(), "id").select("id", "caller")


def callees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, callee: a row for each call by one of ids(id)."""
    calls = edges_of_type(edges, "calls").select(F.col("source").alias("id"), F.col("target").alias("callee"))
    return calls.join(ids.select("id").distinct(), "id").select("id", "callee")


def _calls(edges: DataFrame) -> DataFrame:
    return edges_of_type(edges, "calls").select(F.col("source").alias("src"), F.col("target").alias("dst"))


def rank_symbols(symbols: DataFrame, edges: DataFrame, alpha: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, score by calls; ends of calls that are no known symbols count as well."""
    return graph.page_rank(symbols.select("id"), _calls(edges), alpha, most, tolerance)


def core_symbols(symbols: DataFrame, edges: DataFrame, top: int = 20, **options: float) -> DataFrame:
    """The symbols among the `top` ranked ids, with rank and score; ids without a symbol take a place and are left out."""
    first = rank_symbols(symbols, edges, **options).orderBy(F.col("score").desc(), "id").limit(top)
    listed = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "id"))).alias("a"))  # `top` rows
    ranked = listed.select(F.posexplode("a").alias("at", "x")).select(F.col("x.id").alias("id"), (F.col("at") + 1).alias("rank"), (-F.col("x.k")).alias("score"))
    return symbols.join(F.broadcast(ranked), "id")


def related_symbols(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """start, id, depth: symbols within `depth` calls of each of starts(id), in either direction."""
    return graph.related(_calls(edges), starts, depth)


def call_chain(edges: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    return graph.call_chains(_calls(edges), source, target, most)


def import_graph(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """src_module, dst_module: different modules joined by an import between known symbols."""
    a = symbols.select(F.col("id").alias("source"), module_name(F.col("file")).alias("src_module"))
    b = symbols.select(F.col("id").alias("target"), module_name(F.col("file")).alias("dst_module"))
    joined = edges_of_type(edges, "imports").join(a, "source").join(b, "target")
    return joined.select("src_module", "dst_module").where("src_module <> dst_module").distinct()


def symbol_diagram(symbols: DataFrame, edges: DataFrame, top: int = 50, **options: float) -> DataFrame:
    """diagram: one row of text with the `top` ranked symbols, by file, larger files first, and the edges among the ranked ids, each
    pair once with its first label."""
    ranked = rank_symbols(symbols, edges, **options).orderBy(F.col("score").desc(), "id").limit(top)
    place = ranked.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "id"))).alias("a")
    ).select(F.posexplode("a").alias("at", "x")).select("at", F.col("x.id").alias("id"))
    shown = symbols.join(F.broadcast(place), "id")
    line = F.concat(F.lit("    "), symbol_diagram_id(F.col("id")), F.lit("["), kind_icon(F.col("kind")), F.lit(" "), "name", F.lit("]"))
    groups = shown.groupBy("file").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("own"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")
    head = F.concat(F.lit("  subgraph "), symbol_diagram_id(stem))
    block = F.concat(F.array(head), F.transform("own", lambda x: x["line"]), F.array(F.lit("  end")))
    blocks = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", block.alias("lines")))).alias("blocks"))
    ids = F.broadcast(place.select("id"))
    among = edges.join(ids.withColumnRenamed("id", "source"), "source").join(ids.withColumnRenamed("id", "target"), "target")
    labelled = among.groupBy("source", "target").agg(F.min(F.struct("line", "edge_type")).alias("first"))
    arrow = F.concat(
        F.lit("  "), symbol_diagram_id(F.col("source")), F.lit(" -->|"), edge_label(F.col("first.edge_type")), F.lit("| "),
        symbol_diagram_id(F.col("target"))
    )
    arrows = labelled.agg(F.array_sort(F.collect_list(F.struct("source", "target", arrow.alias("line")))).alias("arrows"))
    lines = F.concat(F.flatten(F.transform("blocks", lambda x: x["lines"])), F.array(F.lit("")), F.transform("arrows", lambda x: x["line"]))
    text = F.concat_ws("\n", F.array(F.lit("graph TD")), F.when(F.size("blocks") > 0, lines))
    return blocks.crossJoin(arrows).select(text.alias("diagram"))


def to_json(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """json: one row with all symbols by id, all edges, and counts; for a graph that fits a document."""
    rows = symbols.agg(F.array_sort(F.collect_list(F.struct("id", F.struct(*_names(SYMBOLS)).alias("s")))).alias("s"), F.count("*").alias("n_s"))
    links = edges.agg(F.array_sort(F.collect_list(F.struct(*_names(SYMBOL_EDGES)))).alias("edges"), F.count("*").alias("n_e"))
    kinds = kind_counts(symbols).agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("by_kind"))
    counts = F.struct(F.col("n_s").alias("total_symbols"), F.col("n_e").alias("total_edges"), "by_kind").alias("stats")
    every = F.map_from_entries(F.transform("s", lambda x: F.struct(x["id"], x["s"]))).alias("symbols")
    return rows.crossJoin(links).crossJoin(kinds).select(F.to_json(F.struct(every, "edges", counts)).alias("json"))


def from_json(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of text(json) as to_json() writes it; what is missing is null."""
    whole = text.select(F.from_json("json", f"symbols map<string,struct<{_typed(SYMBOLS)}>>, edges array<struct<{_typed(SYMBOL_EDGES)}>>").alias("g"))
    symbols = whole.select(F.explode(F.map_values("g.symbols")).alias("s")).select("s.*")
    return symbols, whole.select(F.inline("g.edges"))


def summary(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n: totals, files with symbols, and each kind that occurs."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    files = symbols.agg(F.count_distinct("file").alias("n")).select(F.lit("files").alias("name"), "n")
    kinds = kind_counts(symbols, zeros=False).select(F.col("kind").alias("name"), "n")
    return reduce(DataFrame.union, (total(symbols, "symbols"), total(edges, "edges"), files, kinds))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _typed(schema: str) -> str:
    return ",".join(c.replace(" ", ":", 1) for c in schema.split(", "))

"""Strongly connected components of a directed graph, by trimming and forward-backward colouring over DataFrames.

A round first trims: a vertex that nothing left points to, or that points to nothing left, lies on no cycle and is a component of its own; so
the chains and trees of a graph go without any search. Then colours spread forward: every vertex takes the smallest vertex that reaches it,
those whose colour changed handing it on, until none changes. A vertex that kept its own name is the smallest of its component, and the
component is what reaches it backward within its colour. These go, and the rest, if any, is the next round's graph. Rounds end when no
edge is left. All steps are joins and aggregates keyed by vertex; tables of earlier turns are removed as the next are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.graph import simple_edges
from codequarry.session import discard, written

#: Trims in a row before colours are tried; what they leave of a chain, later rounds trim.
TRIMS = 3


def _both_ends(edges: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges whose ends are both in ids(id), or both not."""
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, how)
    return edges.select("src", "dst")


def _trimmed(edges: DataFrame) -> DataFrame:
    for _ in range(TRIMS):
        inner = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
        kept = written(_both_ends(edges, inner))
        settled = kept.count() == edges.count()
        discard(edges)
        edges = kept
        if settled:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """id, colour: the smallest vertex that reaches each vertex of edges, itself included; each turn writes one table, which also tells whose colour changed."""
    colours = written(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.col("id").alias("colour"), F.lit(True).alias("moved")))
    while True:
        front = colours.where("moved").select(F.col("id").alias("src"), "colour")
        given = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("given"))
        smaller = F.coalesce(F.col("given") < F.col("colour"), F.lit(False))
        after = written(colours.join(given, "id", "left").select("id", F.when(smaller, F.col("given")).otherwise(F.col("colour")).alias("colour"), smaller.alias("moved")))
        discard(colours)
        colours = after
        if colours.where("moved").isEmpty():
            return colours


def _backward(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """id, component: vertices that reach the vertex their colour is named by, within the colour."""
    a, b = colours.select(F.col("id").alias("src"), F.col("colour").alias("c")), colours.select(F.col("id").alias("dst"), F.col("colour").alias("d"))
    inner = written(edges.join(a, "src").join(b, "dst").where("c = d").select("src", "dst"))
    top = F.col("id") == F.col("colour")
    reached = written(colours.select("id", "colour", top.alias("reached"), top.alias("moved")))
    discard(colours)
    while not reached.where("moved").isEmpty():
        step = inner.join(reached.where("moved").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(True).alias("hit")).distinct()
        new = ~F.col("reached") & F.col("hit").isNotNull()
        after = written(reached.join(step, "id", "left").select("id", "colour", (F.col("reached") | new).alias("reached"), new.alias("moved")))
        discard(reached)
        reached = after
    found = written(reached.where("reached").select("id", F.col("colour").alias("component")))
    discard(inner, reached)
    return found


def strong_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, component for every vertex of edges(src, dst) and vertices(id): the smallest vertex of its strongly connected component."""
    links = written(simple_edges(edges))
    every = links.select(F.col("src").alias("id")).union(links.select("dst"))
    every = written((every if vertices is None else every.union(vertices.select("id"))).distinct())
    found = []
    while True:
        links = _trimmed(links)
        if links.isEmpty():
            break
        some = _backward(links, _coloured(links))
        found.append(some)
        rest = written(_both_ends(links, some, "left_anti"))
        discard(links)
        links = rest
    if not found:
        return every.select("id", F.col("id").alias("component"))
    known = reduce(DataFrame.union, found)
    return every.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def inner_edges(edges: DataFrame) -> DataFrame:
    """The edges that lie on some cycle: both ends in one component."""
    parts = written(strong_components(edges))
    a, b = parts.select(F.col("id").alias("src"), F.col("component").alias("c")), parts.select(F.col("id").alias("dst"), F.col("component").alias("d"))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").where("c = d").select("src", "dst")

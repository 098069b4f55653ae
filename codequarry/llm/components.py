"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import discard, durable

#: Rounds after which something must be wrong: their number is logarithmic in the size.
MOST_ROUNDS = 200


def _edge(a: str, b: str):  # noqa: ANN202
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: for every vertex of edges(a, b), the smallest id of its component. A round hangs each vertex's
    larger neighbours on its smallest one, then its smaller ones; it ends when a round changes nothing. Each vertex's rows
    meet only in aggregates and in joins with one row a vertex, which can be split."""
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
        # large star: every neighbour larger than v goes to the smallest of v and its neighbours
        both = edges.select(F.explode(F.array(_edge("a", "b"), _edge("b", "a"))).alias("e")).select(F.col("e.a").alias("v"), F.col("e.b").alias("w"))
        least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("w > v").join(least, "v").select(F.col("w").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of v, and v, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.explode(F.array(_edge("a", "m"), _edge("b", "m"))).alias("e"))
        new = durable(hung.select("e.a", "e.b").where("a <> b").distinct())
        discard(edges)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    leaves = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return leaves.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

"""Graphs as vertex and edge tables: ranking, neighbourhoods, paths, cycles, order.

Loops run on the driver over DataFrames; each turn is cut off durably, so plans stay short and a lost executor costs a re-read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators import vertices as vertices_by_number
from codequarry.operators.vertices import Vertices
from codequarry.session import discard, durable, numbered, written


#: Turns of a ranking after which it looks whether it has settled.
TURNS_A_LOOK = 4


def simple_edges(edges: DataFrame) -> DataFrame:
    """edges(src, dst) without loops and parallels."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def page_rank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, score for vertices(id) and edges(src, dst); all vertices count, also those that edges alone name. Vertices without
    out-edges spread their score over all. It stops when the scores' total change in a turn is below n * tolerance, or after `most` turns;
    it looks every few turns. Edges are computed once and kept as pairs of numbers, scores as arrays of buckets of vertices. A turn reads the edges once, where
    they lie: shares of scores are brought to them, and what is sent are sums by target. Its scores are written and the last turn's removed."""
    named = vertices_by_number.written(edges.where("src <> dst").select(F.col("src").alias("tail"), F.col("dst").alias("head")))
    ends = [x.select(F.col(c).alias("id"), F.lit(k).cast("long").alias("k")) for x, c, k in ((vertices, "id", 0), (named, "tail", 0), (named, "head", 1))]
    ids = vertices_by_number.written(reduce(DataFrame.union, ends).groupBy("id").agg(F.sum("k").alias("wanted")))
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("score"))
    known = Vertices(ids, n)
    links = written(known.numbered(named, named.count()))
    discard(ids, named)
    degree = known.by_bucket(links.groupBy("src").agg(F.count("*").alias("deg")), "src", "deg")
    degree = vertices_by_number.written(known.names.join(degree, F.col("bucket") == F.col("to"), "left").select("bucket", F.transform("ids", lambda _, i: F.col("found")[i]).alias("deg")))
    ranks = written(_shared(degree.withColumn("score", F.transform("deg", lambda _: F.lit(1.0 / n)))))
    discard(degree)
    for turn in range(1, most + 1):
        loose = ranks.agg(F.sum("loose")).first()[0]
        shares = known.beside(ranks.select(F.col("bucket").alias("at"), "share"))
        given = links.join(shares, known.bucket("src") == F.col("at")).select("dst", F.get("share", known.place("src")).alias("part"))
        given = known.by_bucket(given.groupBy("dst").agg(F.sum("part").alias("got")), "dst", "got")
        new = F.transform("deg", lambda _, i: alpha * (F.coalesce(F.col("found")[i], F.lit(0.0)) + loose / n) + (1 - alpha) / n)
        turned = ranks.join(given, F.col("bucket") == F.col("to"), "left").select("bucket", "deg", F.col("score").alias("old"), new.alias("score"))
        moved = [_total(F.zip_with("score", "old", lambda a, b: F.abs(a - b))).alias("moved")] if tolerance else []
        turned = written(_shared(turned.select("bucket", "deg", "score", *moved)))
        discard(ranks)
        ranks = turned
        if tolerance and (turn % TURNS_A_LOOK == 0 or turn == most) and turned.agg(F.sum("moved")).first()[0] < n * tolerance:
            break
    discard(links)
    return known.names.join(ranks, "bucket").select(F.inline(F.arrays_zip(F.col("ids").alias("id"), "score"))).select("id", "score")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _shared(ranks: DataFrame) -> DataFrame:
    """ranks, a row a bucket, with each vertex's score for each of its edges, and the scores of those without."""
    share = F.zip_with("score", "deg", lambda score, deg: score / deg)
    loose = _total(F.zip_with("score", "deg", lambda score, deg: F.when(deg.isNull(), score).otherwise(0.0)))
    return ranks.withColumns({"share": share, "loose": loose})


def related(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """start, id, depth: what lies within `depth` undirected steps of each start(id), itself left out, at its least distance."""
    both = durable(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct())
    seen = durable(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, depth + 1):
        step = front.join(both, front["id"] == both["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = durable(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("depth > 0")


def call_chains(edges: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """chain: every simple path from source to target of at most `most` edges; parallel edges give parallel paths. Paths grow from
    the source and are dropped as soon as the target can't be reached in the steps that are left."""
    spark = edges.sparkSession
    if source == target:
        return spark.range(1).select(F.array(F.lit(source)).alias("chain"))
    links = durable(edges.select("src", "dst").where("src <> dst"))
    near = [spark.range(1).select(F.lit(target).alias("id"))]
    for _ in range(most - 1):
        near.append(durable(near[-1].union(links.join(near[-1], links["dst"] == near[-1]["id"], "left_semi").select("src")).distinct()))
    front = spark.range(1).select(F.array(F.lit(source)).alias("chain"))
    found = []
    for left in range(most, 0, -1):
        step = front.join(links, F.element_at("chain", -1) == links["src"]).where(~F.array_contains("chain", F.col("dst")))
        able = near[left - 1]
        front = durable(step.join(able, step["dst"] == able["id"], "left_semi").select(F.array_append("chain", F.col("dst")).alias("chain")))
        found.append(front.where(F.element_at("chain", -1) == target))
        front = front.where(F.element_at("chain", -1) != target)
    return reduce(DataFrame.union, found)


def cycles(edges: DataFrame, most: int = 10, rotations: bool = False) -> DataFrame:
    """cycle: each simple cycle of at most `most` edges, as its vertices with the first again at the end. It begins at its smallest
    vertex, or with rotations at every one. Paths only grow over vertices larger than their first, so none is walked twice."""
    links = durable(simple_edges(edges))
    front = links.where("dst > src").select(F.array("src", "dst").alias("path"))
    found = []
    for _ in range(most - 1):
        step = front.join(links, F.element_at("path", -1) == links["src"]).select("path", "dst")
        step = durable(step.where((F.col("dst") == F.get("path", F.lit(0))) | ((F.col("dst") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("dst")))))
        found.append(step.where(F.col("dst") == F.get("path", F.lit(0))).select("path"))
        front = step.where(F.col("dst") != F.get("path", F.lit(0))).select(F.array_append("path", F.col("dst")).alias("path"))
        if front.isEmpty():
            break
    paths = reduce(DataFrame.union, found)
    if rotations:
        paths = paths.select(
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.concat(
                        F.slice("path", i + 1, F.size("path") - i), F.slice("path", F.lit(1), i)
                    )
                )
            ).alias("path")
        )
    return paths.select(F.array_append("path", F.get("path", F.lit(0))).alias("cycle"))


def levels(items: DataFrame, depends: DataFrame) -> DataFrame:
    """id, level, ord: items(id, ord) by the length of the longest chain of depends(id, on) below them; unknown dependencies are passed
    over, and what lies on or behind a cycle has level null. A turn peels off what depends on nothing that is left."""
    known = depends.join(items.select(F.col("id").alias("on")), "on", "left_semi").join(items.select("id"), "id", "left_semi").select("id", "on").distinct()
    left, waits, done, level = durable(items.select("id", "ord")), durable(known), None, 0
    while True:
        free = durable(left.join(waits.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        left = durable(left.join(free, "id", "left_anti"))
        waits = durable(waits.join(free.select(F.col("id").alias("on")), "on", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return (rest if done is None else done.union(rest)).select("id", "level", "ord")


def topological_ranks(items: DataFrame, depends: DataFrame) -> DataFrame:
    """id, place (from 0): the first-in, first-out order of items(id, ord), as topological_order() tells it, without collecting anything. In that order
    levels follow each other, and an item becomes ready with the last of what it depends on: so within a level items stand by the place of
    that, then by their own order, and each level is ranked from the places of those before. What lies on or behind cycles comes last."""
    leveled = durable(levels(items, depends))
    needs = durable(depends.where("id <> on").join(items.select(F.col("id").alias("on")), "on", "left_semi").select("id", "on").distinct())
    sizes = {r.level: r.n for r in leveled.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row a level
    done, before = None, 0
    for level in [*sorted(x for x in sizes if x is not None), *([None] if None in sizes else [])]:
        own = leveled.where(F.col("level").eqNullSafe(F.lit(level))).select("id", "ord")
        if done is None or level is None:
            own = own.withColumn("last", F.lit(0).cast("long"))
        else:
            places = done.select(F.col("id").alias("on"), F.col("place").alias("at"))
            own = own.join(needs, "id").join(places, "on").groupBy("id", "ord").agg(F.max("at").alias("last"))
        ranked = numbered(own, ["last", "ord", "id"], "place").select("id", (F.col("place") - 1 + before).alias("place"))
        done = durable(ranked if done is None else done.union(ranked))
        before += sizes[level]
    return items.select("id").withColumn("place", F.lit(0).cast("long")).limit(0) if done is None else done


def topological_order(items: DataFrame, depends: DataFrame) -> list[str]:
    """First-in, first-out order of a document map, which fits the driver: items ready at once stand in their own order, the others as
    they become ready, and those on or behind cycles come last in their own order."""
    order = [r.id for r in items.orderBy("ord").select("id").collect()]
    known = set(order)
    needs = {i: 0 for i in order}
    after: dict[str, list[str]] = {i: [] for i in order}
    place = {x: i for i, x in enumerate(order)}
    for r in sorted(depends.distinct().collect(), key=lambda r: place.get(r.id, -1)):
        if r.id in known and r.on in known:
            needs[r.id] += 1
            after[r.on].append(r.id)
    queue, out = [i for i in order if not needs[i]], []
    while queue:
        out.append(queue.pop(0))
        for i in after[out[-1]]:
            needs[i] -= 1
            if not needs[i]:
                queue.append(i)
    return out + [i for i in order if i not in set(out)]

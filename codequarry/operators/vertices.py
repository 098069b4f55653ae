"""Vertices by number, for loops that read all edges of a graph in each turn.

Vertices are dealt into buckets by a hash of their ids; a vertex's number is its bucket and its place there, and what is known of the vertices of a
bucket stands as arrays in one row. So an edge is two numbers, and a value of all vertices is small enough to meet the edges where they lie."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import session
from codequarry.session import dealt, discard, written

#: Vertices of a bucket, on average: a place is found by going through them.
BUCKET = 32
#: So many vertices are broadcast at most, 8 bytes each and about 80 a bucket; with more, the same joins shuffle.
BROADCAST = 1 << 23


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


class Vertices:
    """ids(id, wanted), which are distinct and n, with numbers; wanted: of how many edges it is the target. `names` has bucket, hashes, ids, and spreads: to
    how many tasks a vertex's edges go, null if each has one. Two ids of one hash get other hashes, so a hash tells an id."""

    def __init__(self, ids: DataFrame, n: int) -> None:
        self.n, self.buckets, self.kind = n, -(-n // BUCKET), ids.schema["id"].dataType
        for self.seed in count():
            hashed = ids.select(_hash(F.col("id"), self.seed).alias("hash"), "id", F.ceil(F.col("wanted") / session.TASK).alias("tasks"))
            own = hashed.groupBy(self._dealt("hash").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("hash", "id", "tasks"))).alias("v"))
            spreads = F.when(F.array_max("v.tasks") > 1, F.transform("v.tasks", lambda x: F.greatest(x, F.lit(1))))
            self.names = written(own.select("bucket", F.col("v.hash").alias("hashes"), F.col("v.id").alias("ids"), spreads.alias("spreads")))
            most, same = self.names.agg(F.max(F.size("hashes")), F.sum(F.size("hashes") - F.size(F.array_distinct("hashes")))).first()
            if not same:
                break
            discard(self.names)
        self.bits = (most - 1).bit_length()

    def _dealt(self, key: str) -> Column:
        return F.pmod(F.col(key), F.lit(self.buckets))

    def bucket(self, number: str) -> Column:
        return F.shiftright(number, self.bits)

    def place(self, number: str) -> Column:
        """From 0."""
        return F.col(number).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")

    def beside(self, rows: DataFrame) -> DataFrame:
        """rows, one a bucket, as the right side of a join with edges."""
        return F.broadcast(rows) if self.n <= BROADCAST else rows

    def numbered(self, edges: DataFrame, rows: int) -> DataFrame:
        """src, dst: different pairs of numbers of edges(tail, head), which have so many rows. Edges of a target stand together, so that sums by target have
        few rows to send, those of a much wanted one in several tasks; in a task they stand by src, as lookups near each other are faster."""
        edges = edges.select(*(_hash(F.col(c).cast(self.kind), self.seed).alias(c) for c in ("tail", "head")))
        for end, number in (("tail", "src"), ("head", "dst")):
            known = self.beside(self.names.select(F.col("bucket").alias("own"), "hashes", "spreads"))
            edges = edges.join(known, self._dealt(end) == F.col("own")).withColumn("at", F.array_position("hashes", F.col(end)) - 1)
            salt = F.lit(0) if end == "tail" else F.coalesce(F.pmod(F.xxhash64("src"), F.get("spreads", F.col("at").cast("int"))), F.lit(0))
            edges = edges.withColumns({number: F.shiftleft("own", self.bits).bitwiseOR(F.col("at")), "salt": salt}).drop(end, "own", "hashes", "spreads", "at")
        return dealt(edges, rows, "dst", "salt").distinct().select("src", "dst").sortWithinPartitions("src")

    def by_bucket(self, values: DataFrame, number: str, value: str) -> DataFrame:
        """to, found: each bucket's values by place, as a map; a row of values is a vertex."""
        pairs = F.collect_list(F.struct(self.place(number).alias("k"), F.col(value).alias("v")))
        return values.groupBy(self.bucket(number).alias("to")).agg(F.map_from_entries(pairs).alias("found"))

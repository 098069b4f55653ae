"""Prefix trie of conversations, by distributed MSD radix partitioning over dictionary-encoded turns.

Turns. Every different turn (role and text, told apart by 128 bits of hash) gets a number in a dictionary; texts leave the plan right
there. Positions come from a sort into ranges that splits a long conversation by its turns, so no task holds one whole.

Segments. A conversation is cut into segments of SEGMENT turns. Conversations that share all segments before are a group; equal segments
of a group are one weighted row from then on, so copies cost a partial aggregate. Only what several conversations share goes on to the
next segment: the rest of a conversation that is alone is a chain of nodes and is written as it stands.

Radix partitioning. The rows of a group are a bucket. A bucket of more than LOCAL turns is split by the first turn after what all of
its rows share (the common prefix of its least and greatest row), which makes the nodes of that prefix and a bucket for each turn behind it;
this repeats until all buckets are local. Multikey quicksort then finishes each local bucket in a task, and its recursion emits
the nodes from the leaves up. What lies below a bucket's top is handed up through the rounds and segments in reverse.

A node is named by its depth and the smallest conversation it has. The ids of the conversations that end at a node are hashed as one
sorted stream: ranges make pieces of text of bounded size, and the pieces of a node pass through one hash in order, held one at a time.

Defined results: null role or text counts as empty; null turns come first, rows of one turn number stand in the order of their hashes
(equal rows stay as often as they stand); rows without conv_id belong to no conversation; c%5 takes the sign of c; an empty table has no
node, not even a root; other columns are ignored. Nodes are told by conv_id and depth together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm.common import discard, durable, pieces, table

#: Turns of a segment, turns up to which a bucket is finished in a task, turns that a conversation may take over, bytes of a piece of ids.
SEGMENT, LOCAL, MOST_TAKEN, PIECE = 256, 2048, 8, 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = [x.split()[0] for x in NODE.split(", ")]
BUCKET = ["top_depth", "top", "digit"]


# ---- turns ---------------------------------------------------------------------------------------

def _encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, place, id, bytes: turns with the numbers of the dictionary instead of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = [F.xxhash64(F.lit(i), role, text).alias(f"d{i}") for i in (1, 2)]
    size = F.octet_length(text).cast("long").alias("bytes")
    turns = durable(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("place"), *digest, size))
    # numbers need to be different and nothing else: they are dealt out by the tasks that hold the distinct turns
    words = durable(turns.select("d1", "d2").distinct().withColumn("id", F.monotonically_increasing_id()))
    return turns.join(words, ["d1", "d2"]).select("conv_id", "place", "id", "bytes", "d1", "d2")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, pos, id, bytes) of the rebuilt conversations, positions from 0, and convs(conv_id, length)."""
    order = [F.col("place").asc_nulls_first(), "d1", "d2"]
    ranged = durable(_encoded(conversations).repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    counts = durable(ranged.groupBy("range", "conv_id").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("conv_id").agg(F.sum("n").alias("size"))
    h = F.crc32(F.col("conv_id").cast("string")) % (MOST_TAKEN + 1)
    convs = sizes.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    head = F.least("h", F.coalesce("base_size", F.lit(0))).alias("head")
    convs = durable(convs.select("conv_id", "base", "h", head, "size"))
    # what a range holds of a conversation is the key of all joins with turns, and a range is bounded
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    info = counts.select("range", "conv_id", before.alias("before")).join(convs.select("conv_id", "h", "head"), "conv_id")
    own = F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order)) - 1
    turns = ranged.withColumn("own", own).join(info, ["range", "conv_id"])
    turns = durable(turns.select("conv_id", (F.col("before") + F.col("own")).alias("pos"), "id", "bytes", "h", "head"))
    first = turns.where(F.col("pos") < MOST_TAKEN).select(F.col("conv_id").alias("base"), "pos", "id", "bytes")
    heads = convs.where("head > 0").select("conv_id", "base", "head").join(first, "base").where("pos < head").select("conv_id", "pos", "id", "bytes")
    tails = turns.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "id", "bytes")
    length = F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    return durable(heads.union(tails)), durable(convs.select("conv_id", length.alias("length")))


# ---- ids that end at a node ----------------------------------------------------------------------

def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id, as pieces of comma-joined ids."""
    key, first, ids, size, out = None, None, [], 0, []

    def flush() -> None:
        nonlocal ids, size
        if ids:
            out.append((*key, first, ",".join(ids)))
        ids, size = [], 0

    def batch_of() -> pa.RecordBatch:
        names = ["top", "e1", "e2", "first", "piece"]
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], names)
        out.clear()
        return made

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("top", "e1", "e2", "conv_id")), strict=True):
            if row[:3] != key or size > PIECE:
                flush()
                key, first = row[:3], row[3]
            ids.append(str(row[3]))
            size += len(ids[-1]) + 1
        if len(out) >= 1000 or sum(len(r[4]) for r in out) > 64 * PIECE:
            yield batch_of()
    flush()
    yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first id, as a hash a key."""
    key, h, out = None, None, []
    for batch in pieces(batches, 64):
        for row in zip(*(batch.column(c).to_pylist() for c in ("top", "e1", "e2", "piece")), strict=True):
            if row[:3] == key:
                h.update(b"," + row[3].encode())
                continue
            if key is not None:
                out.append((*key, h.hexdigest()))
            key, h = row[:3], hashlib.sha256(row[3].encode())
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["top", "e1", "e2", "ends"])
            out = []
    if key is not None:
        out.append((*key, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["top", "e1", "e2", "ends"])


def ends_of(enders: DataFrame) -> DataFrame:
    """top, e1, e2, ends for enders(top, e1, e2, conv_id): the hash of a key's ids, ascending."""
    ranged = enders.repartitionByRange("top", "e1", "e2", "conv_id").sortWithinPartitions("top", "e1", "e2", "conv_id")
    cut = ranged.mapInArrow(_id_pieces, "top long, e1 long, e2 long, first long, piece string")
    cut = cut.repartition("top", "e1", "e2").sortWithinPartitions("top", "e1", "e2", "first")
    return cut.mapInArrow(_hashed, "top long, e1 long, e2 long, ends string")


# ---- local buckets -------------------------------------------------------------------------------

class _Bucket:
    """Rows (ids, bytes, convs, smallest, ends, children, leaves, saved) of a bucket, all with the same first turns; the last three tell what follows
    behind a row's end in later segments. nodes() sorts them by multikey quicksort and tells the nodes below the bucket's top."""

    def __init__(self, rows: list[tuple], start: int, top_depth: int, top: int):
        self.rows, self.start, self.top_depth, self.top, self.out = rows, start, top_depth, top, []

    def nodes(self) -> tuple[int, int, int]:
        """Children, leaves and saved tokens below the top; out gets the nodes."""
        below = self._below(list(range(len(self.rows))), self.top_depth - self.start, self.top)
        return below[:3]

    def _equal(self, group: list[int], k: int) -> Iterator[list[int]]:
        """Groups with the same turn at k, in its order: less, equal and greater than a pivot, until a group is equal."""
        stack = [(group, False)] if group else []
        while stack:
            some, done = stack.pop()
            if done or len(some) == 1:
                yield some
                continue
            digits = [self.rows[i][0][k] for i in some]
            pivot = sorted((digits[0], digits[len(digits) // 2], digits[-1]))[1]
            less = [i for i, x in zip(some, digits, strict=True) if x < pivot]
            more = [i for i, x in zip(some, digits, strict=True) if x > pivot]
            same = [i for i, x in zip(some, digits, strict=True) if x == pivot]
            stack += [(x, d) for x, d in ((more, False), (same, True), (less, False)) if x]

    def _chain(self, i: int, k: int, parent: int) -> tuple[int, int, int]:
        """The nodes of a row that is alone from its turn k on, deepest first."""
        ids, size, n, m, ends, children, leaves, saved = self.rows[i]
        leaves = leaves or 1
        for at in range(len(ids), k, -1):
            saved += (n - 1) * size[at - 1]
            last = at == len(ids)
            self.out.append((m, self.start + at, m if at > k + 1 else parent, n, children if last else 1, leaves, saved, ends if last else NO_ENDS))
        return 1, leaves, saved

    def _below(self, group: list[int], k: int, parent: int) -> tuple:
        """Children, leaves, saved and the row that ends here, of the node whose rows share k turns."""
        ended = next((i for i in group if len(self.rows[i][0]) == k), None)
        children, leaves, saved = self.rows[ended][5:8] if ended is not None else (0, 0, 0)
        for same in self._equal([i for i in group if i != ended], k):
            if len(same) == 1:
                c, x, s = self._chain(same[0], k, parent)
            else:
                m, n = min(self.rows[i][3] for i in same), sum(self.rows[i][2] for i in same)
                size = self.rows[same[0]][1][k]
                c, x, s, end = self._below(same, k + 1, m)
                s += (n - 1) * size
                self.out.append((m, self.start + k + 1, parent, n, c, x, s, NO_ENDS if end is None else self.rows[end][4]))
            children, leaves, saved = children + 1, leaves + x, saved + s
        return children, leaves, saved, ended


def _finish(start: int):  # noqa: ANN202
    """Rows sorted by bucket, as nodes and a summary a bucket."""
    names = ["ids", "sizes", "n", "m", "ends", "children", "leaves", "saved"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            if key is not None:
                bucket = _Bucket(rows, start, key[0], key[1])
                children, leaves, saved = bucket.nodes()
                out.extend((*x, None) for x in bucket.out)
                out.append((key[1], key[0], None, 0, children, leaves, saved, None, key[2]))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string() if c == "ends_sha256" else pa.int64() for c in NODE_COLUMNS] + [pa.int64()]
            made = [pa.array([r[i] for r in out], kinds[i]) for i in range(len(kinds))]
            out.clear()
            return pa.RecordBatch.from_arrays(made, [*NODE_COLUMNS, "digit"])

        for batch in pieces(batches, 2000):
            columns = [batch.column(c).to_pylist() for c in (*BUCKET, *names)]
            for row in zip(*columns, strict=True):
                if row[:3] != key:
                    close()
                    key, rows = row[:3], []
                rows.append(row[3:])
            if len(out) >= 4096:
                yield batch_of()
        close()
        yield batch_of()

    return finish


# ---- radix partitioning --------------------------------------------------------------------------

def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    differs = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.coalesce(F.get(differs, 0), F.least(F.size(a), F.size(b)))


def _split(rows: DataFrame, start: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Rows of local buckets, and of each round the split buckets with the rows that end at their shared prefix's last node."""
    rows = rows.withColumns({"top_depth": F.lit(start).cast("long"), "digit": F.lit(-1).cast("long")})
    local, rounds = None, []
    while True:
        cost = F.sum(F.size("ids") + 1 + start - F.col("top_depth"))
        bounds = [F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi")]
        found = durable(rows.groupBy(*BUCKET).agg(cost.alias("cost"), F.sum("n").alias("n"), F.min("m").alias("m"), *bounds))
        large = found.where(F.col("cost") > LOCAL)
        shared = _shared(F.col("lo.ids"), F.col("hi"))
        depth = F.col("shared") + start
        large = large.withColumn("shared", shared).withColumn("depth", depth).withColumn("node", F.when(depth > F.col("top_depth"), F.col("m")).otherwise(F.col("top")))
        large = durable(large.select(*BUCKET, "n", "m", "lo", "shared", "depth", "node"))
        if large.isEmpty():
            return (rows if local is None else local.unionByName(rows)), rounds
        # buckets to split are at most one in LOCAL of the turns
        kept = rows.join(large.select(*BUCKET), BUCKET, "left_anti")
        local = kept if local is None else local.unionByName(kept)
        inner = rows.join(large.select(*BUCKET, "shared", "depth", "node"), BUCKET)
        at_node = durable(inner.where(F.size("ids") == F.col("shared")).select(F.col("depth").alias("top_depth"), F.col("node").alias("top"), "ends", "children", "leaves", "saved"))
        rounds.append((large, at_node))
        digit = F.get("ids", F.col("shared"))
        inner = inner.where(F.size("ids") > F.col("shared")).withColumns({"top_depth": F.col("depth").cast("long"), "top": F.col("node"), "digit": digit})
        rows = durable(inner.drop("shared", "depth", "node"))


def _up(summary: DataFrame, large: DataFrame, at_node: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the prefixes that split buckets share, and the summaries of those buckets, from the summaries of what they were split into."""
    counts = ("children", "leaves", "saved")
    under = summary.select("top_depth", "top", F.lit(None).cast("string").alias("ends"), *counts).unionByName(at_node)
    known = under.groupBy(F.col("top_depth").alias("depth"), F.col("top").alias("node")).agg(F.max("ends").alias("ends"), *(F.sum(c).alias(c) for c in counts))
    whole = large.join(known.withColumn("leaves", F.greatest("leaves", F.lit(1))), ["depth", "node"])
    # saved tokens at each depth of the prefix: all from there to its end, and what is under it
    levels = F.when(F.col("depth") > F.col("top_depth"), F.sequence(F.col("top_depth") + 1, F.col("depth"))).otherwise(F.array().cast("array<bigint>"))
    path_saved = lambda d: F.col("saved") + (F.col("n") - 1) * F.aggregate(F.slice("lo.sizes", d - start, F.col("depth") - d + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = durable(whole.withColumn("levels", levels))
    d = F.col("d")
    node = whole.select("*", F.explode("levels").alias("d")).select(
        F.col("m").alias("conv_id"), d.alias("depth"), F.when(d == F.col("top_depth") + 1, F.col("top")).otherwise(F.col("m")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(d == F.col("depth"), F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), path_saved(d).alias("saved_tokens"),
        F.when(d == F.col("depth"), F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    has_path = F.size("levels") > 0
    total = whole.select(
        *BUCKET, F.when(has_path, F.lit(1)).otherwise(F.col("children")).cast("long").alias("children"), "leaves",
        F.when(has_path, path_saved(F.col("top_depth") + 1)).otherwise(F.col("saved")).alias("saved"),
    )
    return node, total


def _segment_nodes(rows: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the tops of the groups of rows(top, ids, sizes, n, m, ends, children, leaves, saved), and children, leaves, saved of each top."""
    local, rounds = _split(rows, start)
    columns = [*BUCKET, "ids", "sizes", "n", "m", "ends", "children", "leaves", "saved"]
    local = local.select(*columns).repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    done = durable(local.mapInArrow(_finish(start), f"{NODE}, digit long"))
    nodes = done.where("digit is null").select(NODE_COLUMNS)
    names = {"depth": "top_depth", "conv_id": "top", "n_children": "children", "n_leaves": "leaves", "saved_tokens": "saved"}
    summary = done.where("digit is not null").select("digit", *names).withColumnsRenamed(names)
    for large, at_node in reversed(rounds):
        more, total = _up(summary, large, at_node, start)
        nodes, summary = nodes.unionByName(more), durable(summary.unionByName(total))
    tops = summary.where((F.col("digit") == -1) & (F.col("top_depth") == start))
    return nodes, durable(tops.select("top", "children", "leaves", "saved"))


def _segments(turns: DataFrame) -> DataFrame:
    """conv_id, segment, ids, sizes: at most SEGMENT turns a row."""
    some = turns.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("t"))
    return some.select("conv_id", "segment", F.col("t.id").alias("ids"), F.col("t.bytes").alias("sizes"))


def _chains(turns: DataFrame, alone: DataFrame) -> DataFrame:
    """Nodes of the conversations alone(conv_id, start, length, top) behind their first `start` turns; top is the node that they leave."""
    some = turns.join(alone, "conv_id").where(F.col("pos") >= F.col("start"))
    last = F.col("pos") + 1 == F.col("length")
    return some.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("start"), F.col("top")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turns(conv_id, pos, id, bytes) of convs(conv_id, length); conversations may have no turn."""
    least = convs.agg(F.min("conv_id")).first()[0]
    if least is None:
        return turns.sparkSession.createDataFrame([], NODE)
    segments = durable(_segments(turns))
    # down: which conversations are in one group, segment by segment, as long as a group has several that go on
    no_turns = F.array().cast("array<bigint>")
    live = convs.select("conv_id", "length", F.lit(least).cast("long").alias("top"))
    held, alone, number = [], [], 0
    while True:
        end = (number + 1) * SEGMENT
        own = segments.where(F.col("segment") == number).drop("segment")
        rows = live.join(own, "conv_id", "left").withColumns({"ids": F.coalesce("ids", no_turns), "sizes": F.coalesce("sizes", no_turns)})
        rows = durable(rows.withColumns({"e1": F.xxhash64(F.lit(1), "ids"), "e2": F.xxhash64(F.lit(2), "ids"), "goes_on": F.col("length") > end}))
        going = F.sum(F.col("goes_on").cast("long")).alias("going")
        equal = durable(rows.groupBy("top", "ids", "sizes", "e1", "e2").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), going))
        ends = ends_of(rows.where("not goes_on").select("top", "e1", "e2", "conv_id"))
        held.append((number * SEGMENT, equal, durable(ends)))
        on = rows.where("goes_on").join(equal.where("going > 0").select("top", "e1", "e2", "m", "going"), ["top", "e1", "e2"])
        on = durable(on.select("conv_id", "length", F.col("m").alias("top"), "going"))
        discard(rows)
        alone.append(on.where("going = 1").select("conv_id", F.lit(end).cast("long").alias("start"), "length", "top"))
        live = on.where("going > 1").select("conv_id", "length", "top")
        if live.isEmpty():
            break
        number += 1
    # up: nodes of each segment, with what lies behind it
    nodes, behind = None, None
    for start, equal, ends in reversed(held):
        one = F.when(F.col("going") == 1, F.lit(1)).otherwise(F.lit(0)).cast("long")
        rows = equal.join(ends, ["top", "e1", "e2"], "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
        if behind is None:
            rows = rows.withColumns({"children": one, "leaves": one, "saved": F.lit(0).cast("long")})
        else:
            rows = rows.join(behind.withColumnRenamed("top", "m").withColumn("more", F.lit(True)), "m", "left")
            more = F.col("more").isNotNull() & (F.col("going") > 1)  # a group is named by its smallest conversation
            rows = rows.withColumns({c: F.when(more, F.col(c)).otherwise(one if c != "saved" else F.lit(0).cast("long")) for c in ("children", "leaves", "saved")})
        rows = durable(rows.select("top", "ids", "sizes", "n", "m", "ends", "children", "leaves", "saved"))
        some, behind = _segment_nodes(rows, start)
        nodes = some if nodes is None else nodes.unionByName(some)
    for some in alone:
        nodes = nodes.unionByName(_chains(turns, some))
    empty = rows.where(F.size("ids") == 0).select("ends")  # at most one row: the conversations without a turn
    n = convs.count()
    root = behind.select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"),
        F.col("children").alias("n_children"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    root = root.join(F.broadcast(empty.withColumnRenamed("ends", "ends_sha256")), F.lit(True), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return nodes.unionByName(root).select(NODE_COLUMNS)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


#: Prefixes as lists are the keys of the nodes; crc32 of a decimal id by its bytes, eight shifts each.
ORACLE = f"""
WITH t AS (SELECT conv_id::BIGINT AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS size, list({{'r': r, 'x': x}} ORDER BY pos) AS turns FROM t GROUP BY c),
crc AS (SELECT *, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT),
    lambda acc, b: list_reduce([xor(acc, b)] || range(1, 9), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 9 AS h FROM a),
seq AS (SELECT a.c, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS q FROM crc a LEFT JOIN crc b ON b.c = a.c - a.c % 5),
p AS (SELECT c, q[1:d] AS k, d, len(q) = d AS ends FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM seq)),
n AS (SELECT k, d, min(c) AS m, count(*) AS n, list(c ORDER BY c) FILTER (WHERE ends) AS e,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(k[d].x) END AS own FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
full_n AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.k = kids.k),
up AS (SELECT k[1:j] AS k, own, n_children FROM (SELECT k, own, n_children, unnest(range(0, d + 1)) AS j FROM full_n)),
sums AS (SELECT k, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM up GROUP BY k)
SELECT n.m AS conv_id, n.d::BIGINT AS depth, above.m AS parent_conv_id, n.n AS n_convs, n.n_children::BIGINT AS n_children, sums.leaves AS n_leaves,
    sums.saved::BIGINT AS saved_tokens, sha256(coalesce(array_to_string(n.e, ','), '')) AS ends_sha256
FROM full_n n JOIN sums ON n.k = sums.k LEFT JOIN n above ON n.d > 0 AND above.d = n.d - 1 AND above.k = n.k[1:n.d - 1]
"""  # noqa: S608

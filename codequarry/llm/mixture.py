"""Mixing sources to target weights, in DataFrame functions only.

The words of each source's documents are packed into blocks of BLOCK words: documents are put in a
pseudorandom order and cut where a block is full, so that a block holds pieces of documents. The mix is
a sequence of output shards of SHARD slots. First each shard draws how many slots it gives to every source: a
multinomial draw, conditional on every source's slots adding up to its target. (All slots are dealt to the
shards by one permutation of the whole mix and counted, which is that draw; nothing but the counts is kept.)
Prefix sums of the counts over the shards number each source's slots. A source's k-th slot takes block k mod n of
the source's blocks after a permutation of its own, one per pass; a pass uses every block once, so no block and
hence no document is used more often than the target's ratio, rounded up. Slots and blocks meet by an equi-join on index.

Positions in a source come from prefix sums in two levels (hash ranges, then within a range), so
that no task holds a whole source. The last block of a source may be shorter.

Defined results: null or wordless texts have size 0 and are never taken; a null source is a source of
its own; rows of equal id, source and text share blocks' words in a fixed order; reruns agree; an empty table gives no
rows; extra columns are ignored. Tables of one row a source are taken in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm.common import durable, let, table

#: Words of a block, and slots of an output shard.
BLOCK, SHARD = 64, 4096
#: Fixed values of the contract: weights in turn, share of all words that is taken, and most uses of a word.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents in a hash range of a source, about.
RANGE = 400


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for documents sizes(source, size). The level to which weights fill up is found in closed
    form: with sources by their ratio of limit to weight, those before the level's own are at their limit.
    Documents are summed first, so the windows without a partition see one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    ranked = per.select("source", "source_size", F.get(F.array(*(F.lit(w) for w in weights)), turn).alias("weight"), (most * F.col("source_size")).alias("limit"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (share * F.sum("source_size").over(everything) - before) / after)
    filled = levels.withColumn("fill", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything))
    return filled.select("source", "source_size", F.least(F.col("limit"), F.coalesce("fill", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _named(source: Column) -> Column:
    """A source's name for joins: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, name, h (hash of id and text), size, one row for each of docs(doc_id, source, text)."""
    return durable(
        docs.select(
            "doc_id", "source", _named(F.col("source")).alias("name"), F.xxhash64("doc_id", "text").alias("h"),
            word_count(F.col("text")).alias("size")
        )
    )


def _firsts(sums: DataFrame, upper: int) -> DataFrame:
    """name, part, first: for sums(name, part, size), the sizes of a name's parts before each, in two levels: within a range of
    `upper` parts, and of the ranges, so that no task holds all parts of a name unless they are few."""
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("size").over(w), F.lit(0))
    ranged = sums.withColumn("super", F.floor(F.col("part") / upper))
    supers = ranged.groupBy("name", "super").agg(F.sum("size").alias("size")).withColumn("base", total(before(["name"], "super"))).drop("size")
    inner = ranged.withColumn("inner", total(before(["name", "super"], "part"))).drop("size")
    return inner.join(supers, ["name", "super"]).select("name", "part", (F.col("inner") + F.col("base")).alias("first"))


def positions(sizes: DataFrame) -> DataFrame:
    """sizes with `at`, the first word of each document in its source's pseudorandom order. Prefix sums in three
    levels: of documents within a range, of ranges within a super-range, and of those within the source."""
    ranges = max(1, sizes.count() // RANGE)
    dealt = sizes.withColumn("part", F.pmod("h", F.lit(ranges)))
    sums = durable(dealt.groupBy("name", "part").agg(F.sum("size").alias("size")))
    within = Window.partitionBy("name", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = _firsts(sums, max(1, int(ranges**0.5)))
    return inner.join(starts, ["name", "part"]).select(*sizes.columns, (F.col("own") + F.col("first")).alias("at"))


#: Times that rows and columns are rotated in turn.
TURNS = 3


def permuted(k: Column, n: Column, salt: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at k. The numbers are laid out in rows of a = ceil(sqrt(n)), the last of which may be
    shorter; in turn every row and every column is rotated by a hash of its number. Rotations map rows and columns onto
    themselves whatever their length, so this is a permutation for any n."""
    parts = lambda x, y: ((x - F.pmod(x, y)) / y).cast("long")
    place = lambda q, r: F.struct(q.alias("q"), r.alias("r"))
    rotated = lambda x, by, size: F.pmod(x + F.pmod(by, size), size)

    def rotations(c: Column) -> Column:
        a, n, salt = c["a"], c["n"], c["salt"]
        at = place(parts(k, a), F.pmod(k, a))
        for turn in range(TURNS):
            row, column = F.lit(2 * turn), F.lit(2 * turn + 1)
            at = let(at, lambda v: place(v["q"], rotated(v["r"], F.xxhash64(salt, row, v["q"]), F.least(a, n - v["q"] * a))))  # noqa: B023
            at = let(at, lambda v: place(rotated(v["q"], F.xxhash64(salt, column, v["r"]), parts(n - v["r"] + a - 1, a)), v["r"]))  # noqa: B023
        return let(at, lambda v: v["q"] * a + v["r"])

    return let(F.struct(F.ceil(F.sqrt(n)).cast("long").alias("a"), n.cast("long").alias("n"), salt.cast("long").alias("salt")), rotations)


def shard_counts(plan: DataFrame, total: int, shard: int = SHARD) -> DataFrame:
    """name, shard, n: how many slots each shard draws from every source of plan(name, slots, offset); offsets number all slots
    of the mix. Slots are dealt by a permutation of them all, and counted where they are made."""
    runs = plan.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / shard).cast("long"))))
    dealt = runs.repartition(max(8, min(10_000, total // 50_000)), "name", "run")
    begin = F.col("run") * shard
    every = dealt.select("name", "offset", F.explode(F.sequence(begin, F.least(begin + shard, F.col("slots")) - 1)).alias("k"))
    placed = every.select("name", permuted(F.col("offset") + F.col("k"), F.lit(total), F.lit(7)).alias("place"))
    return placed.groupBy("name", F.expr(f"place div {shard}").alias("shard")).agg(F.count("*").alias("n"))


def draw(goals: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """shard, name, k (the source's slot), pass, block for goals(source, source_size, target): every slot of the mix."""
    ratio = F.col("target") / F.col("source_size")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    plan = goals.where((F.col("source_size") > 0) & (F.col("target") > 0)).select(
        _named(F.col("source")).alias("name"), blocks.alias("blocks"), F.round(ratio * blocks).cast("long").alias("slots")
    )
    plan = plan.where(F.col("slots") > 0)
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    plan = durable(plan.withColumn("offset", F.coalesce(F.sum("slots").over(before), F.lit(0))))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    counts = durable(shard_counts(plan, max(1, total), shard))
    firsts = _firsts(counts.select("name", F.col("shard").alias("part"), F.col("n").alias("size")), max(1, int((total // shard + 1) ** 0.5)))
    numbered = counts.join(firsts.withColumnRenamed("part", "shard"), ["name", "shard"]).join(plan.select("name", "blocks"), "name")
    dealt = numbered.repartition(max(8, min(10_000, total // 50_000)), "name", "shard")
    slots = dealt.select("shard", "name", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    slots = slots.withColumn("pass", F.expr("k div blocks"))
    block = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.xxhash64("name", "pass"))
    return slots.select("shard", "name", "k", "pass", block.alias("block"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """What positions() returns, a row for each block that a document has words in, with `block` and the words' number."""
    many = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    return many.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, one row for each of docs(doc_id, source, text)."""
    sizes = sized(docs)
    goals = durable(targets(sizes.select("source", "size")))
    placed = durable(positions(sizes))
    uses = draw(goals, block).groupBy("name", "block").agg(F.count("*").alias("uses"))
    taken = pieces(placed, block).join(uses, ["name", "block"], "left").groupBy("doc_id", "name", "at", "size").agg(
        F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken")
    )
    empty = placed.where(F.col("size") == 0).select("doc_id", "name", "at", "size", F.lit(0).cast("long").alias("taken"))
    named = goals.withColumn("name", _named(F.col("source"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = taken.unionByName(empty).withColumn("salt", F.pmod(F.xxhash64("at", "doc_id"), F.lit(16)).cast("int"))
    return rows.join(named, ["name", "salt"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The packed mix itself: shard, source, k, pass, block and the block's words, joined with spaces."""
    sizes = sized(docs)
    goals = durable(targets(sizes.select("source", "size")))
    texts = docs.select(_named(F.col("source")).alias("name"), F.xxhash64("doc_id", "text").alias("h"), "text").dropDuplicates(["name", "h"])
    cut = pieces(positions(sizes), block).select("name", "h", "block", "at", "words", (F.greatest("at", F.col("block") * block) - F.col("at")).cast("int").alias("skip"))
    words = F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.col("skip") + 1, F.col("words").cast("int")), " ")
    packed = cut.join(texts, ["name", "h"]).select(
        "name", "block", F.struct("at", "skip", part.alias("text")).alias("piece")
    ).groupBy("name", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    whole = packed.select("name", "block", F.array_join(F.transform("pieces", lambda x: x["text"]), " ").alias("text"))
    return draw(goals, block).join(whole, ["name", "block"]).select(
        "shard", F.when(F.col("name") != "", F.substring("name", 2, 1 << 30)).alias("source"), "k", "pass", "block", "text"
    )


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")

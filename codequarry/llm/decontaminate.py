"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text, shingles are WORDS consecutive words
(a shorter item is one shingle, for which documents are probed with n-grams of its length), and a document contains an item if it holds at least THRESHOLD of
the item's distinct shingles. Items are short and documents long, so Jaccard signatures of whole
documents would say nothing; the search is one-sided instead. Items are partitioned by size (powers of
two of their shingle count), and each partition's signature length is the smallest that cannot miss:
an item of n shingles keeps its n - ceil(THRESHOLD n) + 1 minimal hashes, and a document that holds
enough of the item's shingles holds one of those. Documents are partitioned by the same size classes,
as a document can only contain items up to n / THRESHOLD. Signatures that a document meets make it a
candidate; candidates are verified by counting the item's shingles that the document holds.

Documents are probed without a shuffle while the signatures stay under SIGNATURES_IN_PLAN, a checked
size; beyond that, shingles are joined with the signature table by a shuffle, with the same result.

Defined results: null, empty and wordless texts and items match nothing; an item shorter than WORDS words
is held by every document in which its words follow each other; repeated document rows of one id count as
one document in the pairs found; keep_clean() judges each row by its id and text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import durable, let, sided, table, unused

WORDS, THRESHOLD = 5, 0.8
#: Signature hashes that may stand in the plan as constants (12 bytes each); more go through a join.
SIGNATURES_IN_PLAN = 20_000
#: Item shingles up to which the verification join may broadcast the items' side (16 bytes each).
SHINGLES_TO_BROADCAST = 1_000_000


def _words(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def shingles(text: Column, n: int = WORDS, short: tuple[int, ...] = ()) -> Column:
    """Distinct 64-bit hashes of the text's word n-grams, and of those of the lengths `short` below n. A text of fewer
    than n words is one gram; the hash of an array is that of its elements in a row."""

    def runs(w: Column, m: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - m), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(m))))

    def grams(w: Column) -> Column:
        none = F.array().cast("array<long>")
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)
        found = F.when(F.size(w) >= n, runs(w, n)).otherwise(whole)
        return F.array_distinct(F.concat(found, *(F.when(F.size(w) >= m, runs(w, m)).otherwise(none) for m in short)) if short else found)

    return let(_words(text), grams)


def signatures(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, size_class, h: the minimal hashes of each item of items(item_id, shingles) that no containing document can avoid."""
    need = F.ceil(F.lit(threshold) * F.size("shingles") - F.lit(1e-9)).cast("int")
    signature = F.slice(F.sort_array("shingles"), 1, F.size("shingles") - need + 1)
    return items.select("item_id", F.floor(F.log2(F.size("shingles"))).cast("int").alias("size_class"), F.explode(signature).alias("h"))


def _contained_rows(docs: DataFrame, benchmark: DataFrame, threshold: float, in_plan: int) -> DataFrame:
    """doc_id, key (hash of id and text), item_id, item_shingles, shared for each item of benchmark(item_id, text) that a row of docs(doc_id, text) contains."""
    items = durable(benchmark.select("item_id", F.size(_words(F.col("text"))).alias("words"), shingles(F.col("text")).alias("shingles"))).where(F.size("shingles") > 0)
    short = tuple(sorted(r.words for r in items.where(F.col("words") < WORDS).select("words").distinct().collect()))  # WORDS - 1 lengths at most
    signed = durable(signatures(items, threshold))
    size = signed.count()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    if size <= in_plan:
        classes: dict[int, set[int]] = {}
        for r in signed.select("size_class", "h").distinct().collect():  # in_plan rows at most
            classes.setdefault(r.size_class, set()).add(r.h)

        def met(s: Column) -> Column:
            found = F.lit(False)
            for c, hashes in sorted(classes.items()):
                found = found | ((F.size(s) >= threshold * 2**c) & F.arrays_overlap(s, F.array(*(F.lit(h) for h in sorted(hashes)))))
            return found

        candidates = keyed.where(let(shingles(F.col("text"), short=short), met))
    else:
        held = keyed.select("key", shingles(F.col("text"), short=short).alias("s"))
        probes = held.select("key", F.size("s").alias("size"), F.explode("s").alias("h"))
        large_enough = F.col("size") >= threshold * F.pow(F.lit(2.0), F.col("size_class"))
        met = probes.join(signed.select("h", "size_class").distinct(), "h").where(large_enough)
        candidates = keyed.join(met.select("key").distinct(), "key", "left_semi")
    wanted = items.select("item_id", F.size("shingles").alias("item_shingles"), F.explode("shingles").alias("h"))
    if wanted.count() <= SHINGLES_TO_BROADCAST:
        wanted = F.broadcast(wanted)
    shared = candidates.select("doc_id", "key", F.explode(shingles(F.col("text"), short=short)).alias("h")).join(wanted, "h").distinct()
    return (
        shared.groupBy("doc_id", "key", "item_id", "item_shingles").agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= threshold * F.col("item_shingles") - 1e-9)
    )


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, in_plan: int = SIGNATURES_IN_PLAN) -> DataFrame:
    """Pairs doc_id, item_id, item_shingles, shared for each item of benchmark(item_id, text) that a row of docs(doc_id, text) contains."""
    return _contained_rows(docs, benchmark, threshold, in_plan).groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared").alias("shared"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item of benchmark, with all their columns."""
    key = unused("key", docs.columns)
    held = sided(_contained_rows(docs, benchmark, THRESHOLD, SIGNATURES_IN_PLAN).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(held, key, "left_anti").select(docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by exact shingle strings, without signatures.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
       UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
       UNION SELECT item_id, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT item_id, count(*)::INTEGER AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles
HAVING count(*) >= 0.8 * item_shingles - 1e-9
"""

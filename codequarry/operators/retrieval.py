"""Weights of text chunks by TF-IDF; search.py ranks by them. A chunk's tokens are counted in its own row, and frequent tokens' weights are broadcast,
so that what is shuffled are partial sums by token or chunk, and rows of rare tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import durable, written

TOP_K = 5
#: The most common tokens that are broadcast, or about.
BROADCAST = 200_000
#: Texts whose tokens are counted at once.
AT_ONCE = 512


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zA-Z_][\p{L}\p{N}_]*"), F.lit(0))


def _counted(words: pa.ListArray) -> pa.ListArray:
    """For each list of words, its different words with their numbers."""
    coded = words.flatten().dictionary_encode()
    place = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    size = max(1, len(coded.dictionary))
    pairs, tf = np.unique(place * size + coded.indices.to_numpy(), return_counts=True)
    starts = np.searchsorted(pairs // size, np.arange(len(words) + 1)).astype(np.int32)
    fields = [coded.dictionary.take(pa.array(pairs % size)), pa.array(tf, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(fields, ["token", "tf"]))


def term_arrays(chunks: DataFrame) -> DataFrame:
    """chunks' rows with terms, an array of (token, tf), in place of content; nothing is shuffled."""
    others = [c for c in chunks.columns if c != "content"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), _counted(part.column("terms"))], [*others, "terms"])

    shape = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in others)
    return chunks.select(*others, tokens(F.col("content")).alias("terms")).mapInArrow(count, f"{shape}, terms array<struct<token:string,tf:bigint>>")


def chunk_terms(chunks: DataFrame) -> tuple[DataFrame, int]:
    """chunk_id and terms for chunks(chunk_id, content), and their number. Rows with the same chunk_id count as one chunk of their texts together: those are
    told first, and only they are grouped."""
    rows = written(term_arrays(chunks.select("chunk_id", "content")))
    again = durable(rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("again")))
    n = again.count()
    if not n:
        return rows, rows.count()
    same = F.col("chunk_id").eqNullSafe(F.col("again"))
    again = F.broadcast(again) if n <= BROADCAST else again
    summed = rows.join(again, same, "left_semi").select("chunk_id", F.inline("terms")).groupBy("chunk_id", "token").agg(F.sum("tf").alias("tf"))
    merged = summed.groupBy("chunk_id").agg(F.collect_list(F.struct("token", "tf")).alias("terms"))
    return rows.join(again, same, "left_anti").unionByName(merged), rows.count()


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """chunk_id, token, tf for chunks(chunk_id, content)."""
    return chunks.select("chunk_id", F.explode(tokens(F.col("content"))).alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))


def frequencies(terms: DataFrame) -> DataFrame:
    """token, tf, df: how often each token stands in rows of terms, and in how many."""
    return terms.select(F.inline("terms")).groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def inverse_frequencies(frequency: DataFrame, n: int) -> DataFrame:
    """token, df, idf: ln(n / (df + 1)), which is not above 0 for tokens that nearly all of the n chunks have; tokens whose idf is 0 have none."""
    return frequency.select("token", "df", F.log(F.lit(n) / (F.col("df") + 1)).alias("idf")).where("idf <> 0")


def common_and_rare(idf: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """About BROADCAST of the most common tokens of idf(token, df, idf), to be broadcast, and the others, if any. A token of the others stands in few
    chunks, so none of them is one task's key."""
    total = idf.count()
    if total <= BROADCAST:
        return idf, None
    bound = idf.agg(F.percentile_approx("df", 1 - BROADCAST / total, 10_000)).first()[0]
    return idf.where(F.col("df") > bound), idf.where(F.col("df") <= bound)


def norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def weighted(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """tf's rows with w = tf * idf and what else idf(token, df, idf) has; tokens that the corpus lacks or whose idf is 0 have no weight."""
    common, rare = common_and_rare(idf)
    both = tf.join(F.broadcast(common), "token")
    if rare is not None:
        both = both.unionByName(tf.join(F.broadcast(common.select("token")), "token", "left_anti").join(rare, "token"))
    return both.withColumn("w", F.col("tf") * F.col("idf")).drop("tf", "idf", "df")


def chat_context(hits: DataFrame) -> DataFrame:
    """query_id, context, refs for hits(query_id, rank, path, start_line, end_line, content): the blocks a prompt quotes, in rank order."""
    block = F.concat(
        F.lit("### "), F.col("path"), F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
        F.lit(")\n"), F.col("content")
    )
    ref = F.struct("rank", F.col("path").alias("path"), F.substring("content", 1, 200).alias("snippet"))
    out = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"), F.sort_array(F.collect_list(ref)).alias("refs"))
    return out.select("query_id", F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n").alias("context"), "refs")

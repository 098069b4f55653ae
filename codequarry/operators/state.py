"""State that survives a run: a keyed log with latest values and expiry, generation status, and what has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 7 * 24 * 3600


def latest(log: DataFrame, key: str = "key", time: str = "created_at") -> DataFrame:
    """The last row of each key of a log; ties go to the larger value. A partial aggregate, so a key that is written often costs no more."""
    rest = [c for c in log.columns if c not in (key, time)]
    return log.groupBy(key).agg(F.max(F.struct(F.col(time), *rest)).alias("row")).select(key, "row.*")


def alive(snapshot: DataFrame, now: Column, ttl: int = TTL_SECONDS, time: str = "created_at") -> DataFrame:
    """Rows whose age in seconds is at most ttl; deletions (op = delete) are none."""
    fresh = snapshot.where(now.cast("long") - F.col(time).cast("long") <= ttl)
    return fresh.where("op <> 'delete'") if "op" in snapshot.columns else fresh


def entries(rows: DataFrame, now: Column, op: str = "put") -> DataFrame:
    """Log rows key, created_at, op, value that put rows(key, value) at a time, or with op = delete take them out."""
    value = F.lit(None).cast("string") if op == "delete" else F.col("value")
    return rows.select("key", now.alias("created_at"), F.lit(op).alias("op"), value.alias("value"))


def cached(log: DataFrame, keys: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """key, value for those of keys(key) that a log(key, created_at, op, value) holds and that are not too old; values that are no JSON
    count as missing. Only asked keys are aggregated."""
    own = log.join(keys.select("key").distinct(), "key", "left_semi")
    kept = alive(latest(own), now, ttl)
    return kept.where(F.try_parse_json("value").isNotNull()).select("key", "value")


def pending(docs: DataFrame, records: DataFrame, mode: str = "full") -> DataFrame:
    """Documents that a run generates: in mode `full` all, in `resume` those without a success in records(doc_id, status)."""
    return docs if mode == "full" else docs.join(records.where("status = 'success'").select("doc_id"), "doc_id", "left_anti")


def outcome(generated: DataFrame) -> DataFrame:
    """successful, failed: how many of generated(content) are documents; those with a warning in place of a text are not."""
    ok = ~F.contains(F.coalesce("content", F.lit("Warning")), F.lit("Warning"))
    return generated.agg(F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


def usage(calls: DataFrame) -> DataFrame:
    """Totals of a log of calls(prompt_tokens, completion_tokens, cost)."""
    total = lambda c, t: F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c)
    return calls.agg(F.count("*").alias("calls"), total("prompt_tokens", "long"), total("completion_tokens", "long"), total("cost", "double"))


def statuses(docs: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, status of docs(doc_id) by records(doc_id, status); without a record it is pending."""
    return docs.select("doc_id").join(
        records.groupBy("doc_id").agg(F.max("status").alias("status")), "doc_id", "left"
    ).select("doc_id", F.coalesce("status", F.lit("pending")).alias("status"))


def after_attempt(records: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, status, retry_count: records with results(doc_id, ok) applied; a failure counts as a retry, a placeholder is no success."""
    done = results.select("doc_id", F.when(F.col("ok"), "success").otherwise("failed").alias("new"))
    return records.join(done, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("new", "status").alias("status"),
        (F.coalesce("retry_count", F.lit(0)) + F.when(F.col("new") == "failed", 1).otherwise(0)).alias("retry_count")
    )


def to_retry(records: DataFrame, most: int = 2) -> DataFrame:
    return records.where((F.col("status") == "failed") & (F.col("retry_count") <= most))


def changed(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of pages(id, content) whose md5 differs from that of records(id, hash), or that have none."""
    return pages.withColumn("hash", F.md5("content")).join(
        records.select("id", F.col("hash").alias("old")), "id", "left"
    ).where(~F.col("hash").eqNullSafe(F.col("old"))).drop("old")


def merged(records: DataFrame, pages: DataFrame) -> DataFrame:
    """The record after a run: new hashes replace old ones, ids that are gone stay."""
    new = pages.select("id", F.md5("content").alias("hash"))
    return records.join(new.select("id"), "id", "left_anti").select("id", "hash").union(new)

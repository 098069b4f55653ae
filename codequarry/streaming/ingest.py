"""Incremental ingestion: new files of a folder, and expiring keyed state, as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codequarry.operators.state import TTL_SECONDS


def stream_table(spark: SparkSession, folder: str, name: str = "*") -> DataFrame:
    """Parquet tables of a folder as they appear, each one file or a folder of part files; the schema is that of those already there. The path
    is a pattern, since a stream takes a plain one for a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what there is, in micro-batches, and stop; the checkpoint remembers it, so that the next call takes only what is new."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def counts_by_language(stream: DataFrame) -> DataFrame:
    return stream.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def cached_values(log: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """key, value, created_at, live: a stream log(key, value, created_at, op) as a cache. A row tells a key's new value; rows older than the
    kept one change nothing; a deletion, or the watermark passing an entry's age limit, tells that the key is gone (live is false) and
    drops its state, so the state holds living keys only."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda value, at, live: pd.DataFrame({"key": [key[0]], "value": [value], "created_at": [at], "live": [live]})
        if state.hasTimedOut:
            value, at = state.get
            state.remove()
            yield row(value, pd.Timestamp(at, unit="us"), False)
            return
        new = pd.concat(list(batches))
        last = new.sort_values(["created_at", "value"], na_position="first").iloc[-1]
        at = int(last["created_at"].value // 1000)
        if state.exists and state.get[1] > at:
            return
        if last["op"] == "delete":
            if state.exists:
                state.remove()
            yield row(None, last["created_at"], False)
            return
        state.update((last["value"], at))
        state.setTimeoutTimestamp(max(at // 1000 + 1000 * ttl_seconds, state.getCurrentWatermarkMs() + 1))
        yield row(last["value"], last["created_at"], True)

    marked = log.withWatermark("created_at", "0 seconds").groupBy("key")
    return marked.applyInPandasWithState(
        update, "key string, value string, created_at timestamp, live boolean", "value string, at long", "append",
        GroupStateTimeout.EventTimeTimeout
    )

"""Session-level helpers: tables by name, and durable cuts in the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of two numbers that a task takes, on average, of what is dealt out by counted rows.
TASK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors both reach. Only a local session, as in tests, may name none; it gets
    a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store, where = _store(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path


def durable(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, for loops: discard() removes it as soon as no later plan reads it."""
    spark = df.sparkSession
    path = own_folder(spark, "table")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what written() wrote."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            store, where = _store(df.sparkSession, path)
            store.delete(where, True)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, about n, by their keys, over as many tasks as they need: a session's number of partitions holds for small tables too."""
    return rows.repartition(-(-n // TASK) or 1, *keys)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `name`, their number from 1 in the order of the columns. Rows are sorted into ranges, numbered within each, and moved up by
    the sizes of the ranges before; only those sizes, one a range, meet in one task."""
    ranged = durable(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = ranged.withColumn("__own", own).join(F.broadcast(starts), "__range")
    return out.withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__own", "__before")

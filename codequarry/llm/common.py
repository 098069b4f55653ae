"""What the corpus operators share: table access, written cuts in the lineage, batches of texts, text hashing.

Rows pass through Python as Arrow batches, whose columns are handed on as they are: ids keep their type and all their digits
beside nulls."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract: space, tab, LF, VT, FF, CR.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\x0c\r"

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder for files that driver and executors both reach: the one that spark.checkpoint.dir names. Only a
    local session, as in tests, may name none; it gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def own_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared one, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store, where = _file_system(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    store, where = _file_system(spark, path)
    store.delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """df written as a compressed table in the shared folder and read again, so that a lost executor costs a re-read and not a
    recomputation, and plans behind it stay short."""
    spark = df.sparkSession
    path = own_folder(spark, "table")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what durable() wrote for tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            remove_folder(df.sparkSession, path)


def sided(df: DataFrame, most_rows: int = 500_000, size: Column | None = None) -> DataFrame:
    """df (a few columns of ids or spans) materialised for the small side of a join: marked for broadcast while it has
    at most so many rows, left to a shuffle join beyond. Where rows hold arrays, `size` tells their elements, which then count instead."""
    df = durable(df)
    many = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] if size is not None else df.count()
    return F.broadcast(df) if many <= most_rows else df


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a batch's texts; a null one is empty."""
    return [raw or b"" for raw in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that what is made of a batch is small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def portions(raws: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about `size` bytes together, or of one longer text."""
    begin = 0
    while begin < len(raws):
        total, end = len(raws[begin]), begin + 1
        while end < len(raws) and total + len(raws[end]) <= size:
            total += len(raws[end])
            end += 1
        yield begin, end
        begin = end


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def held_out(doc_id: str = "doc_id") -> Column:
    """The fixed evaluation fold: crc32 of the id's decimal text is divisible by 5. A null id
    can't be in the training fold either, and counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once per row: a lambda's variable is bound, whereas a column
    that is used twice may be inlined, and inside another lambda computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def native_words(text: Column) -> Column:
    """Words of a text as an array, by DataFrame functions; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


# ---- filters over keys ---------------------------------------------------------------------------

#: Bits of a filter over keys, 4 MB whatever the corpus, how many a key sets, and words of 64 bits that reach the driver as one value.
FILTER_BITS, FILTER_HASHES, FILTER_BLOCK = 1 << 25, 3, 4096


def _filter_at(keys: np.ndarray) -> list[np.ndarray]:
    h = np.asarray(keys, dtype=np.int64).view(_U)
    return [(mix64(h + _U(0x517CC1B7 * (i + 1))) & _U(FILTER_BITS - 1)).astype(np.int64) for i in range(FILTER_HASHES)]


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits set for every value of the one bigint column of keys. Blocks of the filter are made on the executors; the driver gets
    them as bytes. A filter only saves work: what passes it wrongly is told apart by the join that follows."""
    name = keys.columns[0]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_filter_at(batch.column(name).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bit"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(FILTER_BLOCK, dtype=np.int64)
        part[pdf["word"].to_numpy(dtype=np.int64) % FILTER_BLOCK] = pdf["bits"]
        return pd.DataFrame({"block": [int(pdf["word"].iloc[0]) // FILTER_BLOCK], "part": [part.tobytes()]})

    words = keys.where(F.col(name).isNotNull()).mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    blocks = words.groupBy(F.floor(F.col("word") / FILTER_BLOCK).alias("block")).applyInPandas(block, "block long, part binary")
    out = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    for r in blocks.collect():
        out[r.block * FILTER_BLOCK : (r.block + 1) * FILTER_BLOCK] = np.frombuffer(r.part, dtype=np.int64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets pass: all that it was made of, and few others."""
    ok = np.ones(len(keys), dtype=bool)
    for at in _filter_at(keys):
        ok &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return ok


# ---- vectorised hashing of words over whole batches of UTF-8 bytes --------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _ODD)
_POWERS = [np.ones(1, dtype=_U)]


def powers(n: int) -> np.ndarray:
    """odd**0 .. odd**n modulo 2**64, kept between calls."""
    if len(_POWERS[0]) <= n:
        p = np.full(max(n + 1, 1 << 16), _ODD, dtype=_U)
        p[0] = 1
        _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, lower: bool = True, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, byte starts and byte ends of the words in raw UTF-8 bytes (A-Z lowered); gaps flags the bytes between words.

    Each hash is a polynomial over randomised byte codes, so it depends on the word alone and not
    on where it stands; words of one length collide with probability near 2**-64."""
    if not len(raw):
        z = np.zeros(0, dtype=np.int64)
        return z.astype(_U), z, z
    if lower:
        raw = _LOWER[raw]
    gap = gaps[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts.astype(_U), starts, ends
    length = ends - starts
    pos = np.arange(len(raw), dtype=np.int64)
    first = np.repeat(starts, length)
    inside = pos[~gap]
    p = powers(int(length.max()))
    terms = _BYTE_CODE[raw[inside]] * p[inside - first]
    total = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(length)[:-1])))
    return mix64(total + length.astype(_U) * _ODD), starts, ends


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, from the words' hashes; order matters."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(m, dtype=_U)
    for i in range(n):
        total = total * _ODD + mix64(words[i : i + m] ^ _U(i + 1))
    return mix64(total)

"""Inputs with every oddity an operator must take: nulls in any column, empty and very long texts, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, salt int, n int, spans string, g string"


def prose(seed: int, n: int, words: str = "the of and ther onin edst reat whou tion ering blea shan") -> str:
    r = random.Random(seed)
    parts = words.split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + ("." if i % 11 == 10 else "") for i in range(n))


def odd_rows() -> list[tuple]:
    long = prose(1, 30_000)
    rows = [(i, prose(i, 80 + i), "en", f"s{i % 3}", 1) for i in range(10, 30)]
    rows += [(i, prose(i, 90, "der ein und schen keit lich ung auch"), "de", "s1", 1) for i in range(30, 40)]
    rows += [
        (1, None, "en", "s0", None), (2, "", None, None, 0), (3, " \n\t\x0b ", "de", "s1", 5), (4, long, "en", "s0", 9), (5, prose(10, 90), "en", None, 1),
        (6, prose(10, 90), None, "s0", 1), (6, prose(10, 90), None, "s0", 1), (None, prose(11, 91), "en", "s0", 1), (None, None, None, None, None),
        (7, "12345 67 !!!", "en", "s2", 1), (8, "word", "en", "s2", 1), (9, "é" * 300 + " 🎉 ß", "de", "s2", 1),
    ]
    return [(*r, "k", 3, 4, "x", "y") for r in rows]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def ids(df: DataFrame) -> list:
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def all_ids() -> list:
    return sorted((r[0] for r in odd_rows()), key=lambda x: (x is None, x or 0))

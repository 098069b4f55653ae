"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts of n-grams of 1 to 3 letters are summed on the executors for a bounded sample of
labelled texts (`TRAIN_ROWS`), the log-probability matrix is made once and broadcast, and texts are scored in
numpy by gathering the matrix rows of their n-grams and summing them per text. Whole texts are scored, in slices
of bounded size. The matrix goes out in blocks of LANGS_AT_ONCE languages, 64 MB each; a text passes through the
blocks in turn and takes its best language and the sum of all along, so any number of languages is scored.

Defined results: null text or text without a letter gives `und` with score 0; no labelled row at
all gives `und` for every text; ties go to the language that sorts first; repeated rows are scored
alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import held_out, table, texts_of, type_of

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.1
#: Bound of the labelled sample that the model is fitted on; rows are chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Languages whose part of the matrix is broadcast at once.
LANGS_AT_ONCE = 256
#: Elements of the gathered matrix held at once while scoring.
SLICE = 6_000_000

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        flags = np.zeros(0x110000, dtype=bool)
        flags[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _letters.append(flags)
    return _letters[0]


def _letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters as one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = _is_letter()[cp]
    if not keep.any():
        return np.zeros(0, dtype=np.uint32)
    cp = np.where(keep, cp, np.uint32(32))
    stay = keep.copy()
    stay[1:] |= keep[:-1]  # of a run of other characters, the first stays as the space
    return np.concatenate(([np.uint32(32)], cp[stay], [np.uint32(32)]))


def _buckets(cp: np.ndarray) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of each order; n-grams that begin with a space stand for word starts."""
    code = cp.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(cp), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(cp) < n:
            return
        h = h[: len(cp) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in ORDERS:
            salt = np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)
            yield ((h * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, group in pdf.groupby("lang", sort=False):
            counts = np.zeros(BUCKETS, dtype=np.int64)
            for text in group["text"]:
                for b in _buckets(_letters_of(text)):
                    counts += np.bincount(b, minlength=BUCKETS)
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at], "rows": 0})
            yield pd.DataFrame({"lang": [lang], "bucket": np.array([-1], dtype=np.int32), "n": [0], "rows": [len(group)]})


class Block:
    """Some languages, a BUCKETS x languages matrix of log probabilities, and their log priors."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.langs, self.log_prob, self.prior = langs, log_prob, prior

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log probabilities per text and language, and whether the text has a letter."""
        n_langs = len(self.langs)
        total = np.zeros((len(texts), n_langs))
        lettered = np.zeros(len(texts), dtype=bool)
        step = max(4096, SLICE // n_langs)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                rows = np.concatenate([b for _, b in held])
                at = np.cumsum([0] + [len(b) for _, b in held[:-1]])
                np.add.at(total, [i for i, _ in held], np.add.reduceat(self.log_prob[rows], at, axis=0))
            held, size = [], 0

        for i, text in enumerate(texts):
            cp = _letters_of(text)
            lettered[i] = len(cp) > 0
            for b in _buckets(cp):
                for k in range(0, len(b), step):
                    held.append((i, b[k : k + step]))
                    size += len(held[-1][1])
                    if size >= step:
                        flush()
        flush()
        return total + self.prior, lettered


class LanguageModel:
    """Fitted naive Bayes: sorted `langs`, their labelled rows, and the n-grams' counts as triplets (language, bucket, n)."""

    def __init__(self, langs: list[str], rows: np.ndarray, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.langs, self.rows, self.lang, self.bucket, self.n = langs, rows, lang, bucket, n

    def blocks(self) -> Iterator[Block]:
        prior = np.log(np.maximum(1, self.rows) / max(1, self.rows.sum()))
        for k in range(0, len(self.langs), LANGS_AT_ONCE):
            langs = self.langs[k : k + LANGS_AT_ONCE]
            own = (self.lang >= k) & (self.lang < k + len(langs))
            counts = np.zeros((BUCKETS, len(langs)))
            counts[self.bucket[own], self.lang[own] - k] = self.n[own]
            log_prob = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * BUCKETS)).astype(np.float32)
            yield Block(langs, log_prob, prior[k : k + len(langs)])


def fit(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on at most about max_rows of the rows of docs(doc_id, text, lang) with text and lang. What the driver holds is bounded by
    the n-grams of that sample."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = docs.where(F.col("lang").isNotNull()).count()
    share = min(1.0, max_rows / max(1, n))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = sample.select("text", "lang").mapInPandas(_count, "lang string, bucket int, n long, rows long")
    pdf = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).toPandas()
    rows = pdf[pdf.bucket < 0].sort_values("lang")
    langs = list(rows["lang"])
    pdf = pdf[pdf.bucket >= 0]
    lang = pdf["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    return LanguageModel(langs, rows["rows"].to_numpy(dtype=float), lang, pdf.bucket.to_numpy(), pdf.n.to_numpy())


def _scorer(shared):  # noqa: ANN001, ANN202
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            total, lettered = block.scores([raw.decode("utf-8", "replace") for raw in texts_of(batch)])
            before, mass = batch.column("top").to_numpy(), batch.column("mass").to_numpy()
            best = total.argmax(axis=1)
            top = np.where(lettered, np.maximum(before, total[np.arange(len(best)), best]), -np.inf)
            with np.errstate(invalid="ignore"):
                grown = mass * np.exp(before - top) + np.exp(total - top[:, None]).sum(axis=1)
            found = [block.langs[b] if m > t else old for b, m, t, old in zip(best, top, before, batch.column("lang").to_pylist())]
            made = [pa.array(found, pa.string()), pa.array(top), pa.array(np.where(lettered, grown, 0.0))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "held_out", "text")] + made, ["doc_id", "held_out", "text", "lang", "top", "mass"])

    return score


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text)."""
    state = F.lit("und").alias("lang"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", *state)
    shape = f"doc_id {type_of(docs, 'doc_id')}, held_out boolean, text string, lang string, top double, mass double"
    for block in model.blocks():
        rows = rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(block)), shape)
    score = F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(F.lit(0.0))  # the best language's share
    return rows.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), score.alias("score"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out())))

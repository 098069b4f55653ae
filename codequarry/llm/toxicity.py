"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text's words (runs of letters and digits) are cut into overlapping windows of WINDOW words, a new one
every STRIDE. Each word enters with a word part (hashed embedding) and a character part (hashed character
trigrams, averaged, and the strongest of its character 4- to 7-grams with word borders). The network reads a
window in both directions, an attention vector pools its states, and a logistic output scores it; the text's
score is that of its highest window. All windows of every whole text are scored.

Labels are of texts, not of windows, so training alternates (multiple instances): every epoch scores all windows
of the training texts, takes each text's highest, and descends on those (Adam, written out below). The first
choice rests on log-odds of words and character n-grams, with which one column of each embedding begins; these stay as
counted, the other columns of words and trigrams are trained with the network. The model is fitted on a bounded, hash-chosen
sample of labelled rows: TRAIN_POSITIVE and TRAIN_NEGATIVE rows of at most TRAIN_TEXT bytes each, TRAIN_BYTES together.

Words are looked up once for each different word of a portion of text, and their inputs are shared by all windows.

Defined results: null, empty and wordless texts score 0; without labelled rows of both kinds every text scores 0;
repeated rows score alike, as do ties of windows; labels given twice for an id count as toxic if one is; null labels are no
labels; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import held_out, mix64, portions, table, texts_of, type_of, word_hashes

WINDOW, STRIDE = 64, 32
#: Bounds of the labelled sample: rows by label, bytes of a text, and bytes of all.
TRAIN_POSITIVE, TRAIN_NEGATIVE, TRAIN_TEXT, TRAIN_BYTES = 1200, 2400, 1 << 20, 1 << 26
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 18
INPUTS, HIDDEN, EPOCHS, BATCH, RATE = 8, 8, 8, 64, 4e-3
#: Rate of the embeddings' own descent, share of words hidden while training, and texts that shrink a log-odds by half.
EMBED_RATE, DROP, SHRINK = 0.05, 0.1, 20
#: Bytes of text that are turned into features at once, and windows that the network reads at once.
BYTES_AT_ONCE, WINDOWS_AT_ONCE = 1 << 20, 1024
GRAMS = (4, 5, 6, 7)
SEED = 7

_GAP = np.ones(256, dtype=bool)
_GAP[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_GAP[128:] = False
_FOLD = np.zeros(256, dtype=np.uint64)
_FOLD[~_GAP] = mix64(np.arange(256, dtype=np.uint64) + np.uint64(99))[~_GAP]
_FOLD[65:91] = _FOLD[97:123]


class Words:
    """The words of a batch of texts: for each different word its word row and character n-gram rows; where each occurrence stands and
    which word it is; and each text's range of occurrences."""

    def __init__(self, texts: list[bytes | str | None]):
        raws = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        raw = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
        hashes, self.starts, self.ends = word_hashes(raw, gaps=_GAP)
        self.raw, self.n = raw, len(hashes)
        bounds = np.searchsorted(self.starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
        self.first, self.last = bounds[:-1], bounds[1:]
        different, one, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (different >> np.uint64(48)).astype(np.int64) & (WORD_ROWS - 1)
        # bytes of the different words, with borders between them that no n-gram spans
        border = max(GRAMS)
        starts, length = self.starts[one], self.ends[one] - self.starts[one]
        begin = np.cumsum(length + border) - (length + border)
        code = np.zeros(int((length + border).sum()), dtype=np.uint64)
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        code[np.repeat(begin, length) + inside] = _FOLD[raw[np.repeat(starts, length) + inside]]
        self.size = length + 1  # n-grams of a word: from the border before each of its bytes, and from its last byte
        self.at = np.cumsum(self.size) - self.size
        own = np.arange(int(self.size.sum())) + np.repeat(begin - self.at, self.size)
        self.trigram = self._grams(code, 3)[own]
        self.longer = [self._grams(code, n)[own] for n in GRAMS]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Places of the n-grams of some different words."""
        size = self.size[words]
        return np.arange(int(size.sum())) + np.repeat(self.at[words] - (np.cumsum(size) - size), size)

    @staticmethod
    def _grams(code: np.ndarray, n: int) -> np.ndarray:
        """Row of the n-gram that begins before each byte."""
        h = np.zeros(len(code), dtype=np.uint64)
        padded = np.concatenate((np.zeros(1, np.uint64), code, np.zeros(n, np.uint64)))
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + padded[i : i + len(code)]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32) & (GRAM_ROWS - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ToxicNet:
    """Parameters p: word (WORD_ROWS x 4) and gram (GRAM_ROWS x 4) embeddings, gates w, u, b of both directions, attention a, output o."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
        self.p = {
            "word": f(WORD_ROWS, 4) * 0.2, "gram": f(GRAM_ROWS, 4) * 0.2, "w": f(INPUTS, 6 * HIDDEN), "u": f(2, HIDDEN, 3 * HIDDEN),
            "b": np.zeros(6 * HIDDEN, np.float32), "a": f(2 * HIDDEN), "o": f(2 * HIDDEN), "c": np.full(1, -1.0, np.float32),
        }
        self.p["word"][:, 0] = 0
        self.p["gram"][:, 0] = 0

    def inputs(self, words: Words) -> np.ndarray:
        """Per different word: 4 of its word row, 3 averaged over its trigrams, 1 as the strongest longer n-gram."""
        x = np.empty((len(words.word), INPUTS), dtype=np.float32)
        if not words.n:
            return x
        x[:, :4] = self.p["word"][words.word]
        x[:, 4:7] = np.add.reduceat(self.p["gram"][:, 1:][words.trigram], words.at, axis=0) / words.size[:, None].astype(np.float32)
        odds = np.ascontiguousarray(self.p["gram"][:, 0])
        best = odds[words.longer[0]]
        for g in words.longer[1:]:
            np.maximum(best, odds[g], out=best)
        x[:, 7] = np.maximum.reduceat(best, words.at)
        return x

    def learn_inputs(self, words: Words, of: np.ndarray, d_x: np.ndarray) -> None:
        """Descend the trained columns of word and trigram rows on the gradient d_x of the inputs of the occurrences of words `of`."""
        total = np.zeros((len(words.word), INPUTS), dtype=np.float32)
        np.add.at(total, of, d_x)
        np.add.at(self.p["word"][:, 1:], words.word, -EMBED_RATE * total[:, 1:4])
        shared = np.repeat(total[:, 4:7] / words.size[:, None].astype(np.float32), words.size, axis=0)
        np.add.at(self.p["gram"][:, 1:], words.trigram, -EMBED_RATE * shared)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):  # noqa: ANN201
        """Scores of windows x (WINDOW, B, INPUTS) with mask (WINDOW, B); with keep also what backward() needs."""
        steps, b = mask.shape
        h3 = 3 * HIDDEN
        return self._read((x.reshape(-1, INPUTS) @ self.p["w"] + self.p["b"]).reshape(steps, b, 2 * h3), mask, keep)

    def _read(self, gates: np.ndarray, mask: np.ndarray, keep: bool):  # noqa: ANN202
        steps, b = mask.shape
        n, h3 = HIDDEN, 3 * HIDDEN
        states = np.empty((2, steps, b, n), dtype=np.float32)
        kept: list = []
        h = np.zeros((2, b, n), dtype=np.float32)
        both = np.empty((2, b, h3), dtype=np.float32)
        real = mask.astype(np.float32)
        for t in range(steps):
            back = steps - 1 - t
            both[0], both[1] = gates[t, :, :h3], gates[back, :, h3:]
            g = np.matmul(h, self.p["u"])
            zr = _sigmoid(both[:, :, : 2 * n] + g[:, :, : 2 * n])
            z, r = zr[:, :, :n], zr[:, :, n:]
            c = np.tanh(both[:, :, 2 * n :] + r * g[:, :, 2 * n :])
            new = c + z * (h - c)
            new[0] *= real[t][:, None]
            new[1] *= real[back][:, None]
            if keep:
                kept.append((h, z, r, c, g[:, :, 2 * n :].copy()))
            h = new
            states[0, t], states[1, back] = h[0], h[1]
        both_ways = np.concatenate((states[0], states[1]), axis=2)
        energy = np.where(mask, both_ways @ self.p["a"], np.float32(-1e9))
        share = np.exp(energy - energy.max(axis=0))
        share *= real
        share /= np.maximum(share.sum(axis=0), 1e-9)
        pooled = (share[:, :, None] * both_ways).sum(axis=0)
        score = _sigmoid(pooled @ self.p["o"] + self.p["c"])
        return (score, both_ways, share, pooled, kept) if keep else score

    def backward(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients by parameter, gradient of x, and the weighted cross-entropy."""
        score, both_ways, share, pooled, kept = self.forward(x, mask, keep=True)
        steps, b = mask.shape
        n = HIDDEN
        loss = -float((weight * np.log(np.clip(np.where(label == 1, score, 1 - score), 1e-7, 1))).sum())
        d = (weight * (score - label)).astype(np.float32)
        grad = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        d_pooled = d[:, None] * self.p["o"]
        d_share = (d_pooled[None] * both_ways).sum(axis=2)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        grad["a"] = np.einsum("tb,tbk->k", d_energy, both_ways)
        d_states = share[:, :, None] * d_pooled[None] + d_energy[:, :, None] * self.p["a"]
        d_u, d_h = np.zeros_like(self.p["u"]), np.zeros((2, b, n), np.float32)
        d_gates = np.zeros((steps, b, 6 * n), np.float32)
        real = mask.astype(np.float32)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            h, z, r, c, gc = kept[t]
            d_new = d_h + np.stack((d_states[t, :, :n], d_states[back, :, n:]))
            d_new[0] *= real[t][:, None]
            d_new[1] *= real[back][:, None]
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * gc * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_c), axis=2)
            d_g = np.concatenate((d_z, d_r, d_c * r), axis=2)
            d_gates[t, :, : 3 * n] += d_x[0]
            d_gates[back, :, 3 * n :] += d_x[1]
            d_u += np.matmul(h.transpose(0, 2, 1), d_g)
            d_h = d_new * z + np.matmul(d_g, self.p["u"].transpose(0, 2, 1))
        flat = d_gates.reshape(-1, 6 * n)
        grad |= {"u": d_u, "w": x.reshape(-1, INPUTS).T @ flat, "b": flat.sum(axis=0)}
        return grad, (flat @ self.p["w"].T).reshape(steps, b, INPUTS), loss

    def window_scores(self, words: Words, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0)
        gates = self.inputs(words) @ self.p["w"] + self.p["b"]
        out = []
        for k in range(0, len(start), WINDOWS_AT_ONCE):
            at = start[k : k + WINDOWS_AT_ONCE] + np.arange(WINDOW)[:, None]
            of = words.of[np.minimum(at, words.n - 1)]
            out.append(self._read(gates[of], at < stop[k : k + WINDOWS_AT_ONCE], keep=False))
        return np.concatenate(out)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of whole texts: the highest window's."""
        out = np.zeros(len(texts))
        for begin, end in portions(texts, BYTES_AT_ONCE):
            words = Words(texts[begin:end])
            owner, start, stop = windows(words)
            np.maximum.at(out, begin + owner, self.window_scores(words, start, stop))
        return out


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end (of its text) of every window."""
    size = words.last - words.first
    many = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(size)), many)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return owner, words.first[owner] + turn * STRIDE, words.last[owner]


def _log_odds(rows: Iterator[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """Per row of an embedding, shrunk log-odds of texts that hold it, positive against negative; rows: label and rows of each text."""
    count, texts = np.zeros((2, size)), np.zeros(2)
    for y, r in rows:
        count[y, np.unique(r)] += 1
        texts[y] += 1
    odds = np.log((count[1] + 0.5) / (texts[1] + 1)) - np.log((count[0] + 0.5) / (texts[0] + 1))
    seen = count.sum(axis=0)
    return (odds * seen / (seen + SHRINK)).astype(np.float32)


def _rows_of(texts: list[bytes], label: np.ndarray, grams: bool) -> Iterator[tuple[int, np.ndarray]]:
    for begin, end in portions(texts, BYTES_AT_ONCE):
        words = Words(texts[begin:end])
        for k, (a, b) in enumerate(zip(words.first, words.last)):
            held = np.unique(words.of[a:b])
            at = words.places(held)
            yield int(label[begin + k]), np.concatenate([g[at] for g in (words.trigram, *words.longer)]) if grams else words.word[held]


def _top_windows(net: ToxicNet, texts: list[bytes], trained: bool) -> dict[int, bytes]:
    """The text of each text's highest window; before training, that of the one with the strongest log-odds."""
    top = {}
    for begin, end in portions(texts, BYTES_AT_ONCE):
        words = Words(texts[begin:end])
        owner, start, stop = windows(words)
        if trained:
            score = net.window_scores(words, start, stop)
        else:
            x = net.inputs(words)
            strongest = np.maximum(x[:, 0], x[:, 7])[words.of]
            score = np.array([strongest[s : min(s + WINDOW, e)].max() for s, e in zip(start, stop)])
        order = np.lexsort((score, owner))
        for w in order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)] if len(order) else order:
            last = min(start[w] + WINDOW, stop[w]) - 1
            top[begin + int(owner[w])] = words.raw[words.starts[start[w]] : words.ends[last]].tobytes()
    return top


def train(texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ToxicNet:
    """Fit on texts with 0/1 labels, of which both occur. Memory holds the texts and one portion's features."""
    net, rng = ToxicNet(seed), np.random.default_rng(seed)
    label = np.asarray(label, dtype=np.float32)
    net.p["word"][:, 0] = _log_odds(_rows_of(texts, label, grams=False), WORD_ROWS)
    net.p["gram"][:, 0] = _log_odds(_rows_of(texts, label, grams=True), GRAM_ROWS)
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())).astype(np.float32) * len(label)
    moment = {k: [np.zeros_like(net.p[k]), np.zeros_like(net.p[k])] for k in ("w", "u", "b", "a", "o", "c")}
    turn = 0
    for epoch in range(epochs):
        top = _top_windows(net, texts, trained=epoch > 0)
        for part in np.array_split(rng.permutation(sorted(top)), max(1, len(top) // BATCH)):
            words = Words([top[i] for i in part])
            at = words.first + np.arange(WINDOW)[:, None]
            mask = at < words.last
            of = words.of[np.minimum(at, words.n - 1)]
            x = net.inputs(words)[of]
            x *= (rng.random(x.shape[:2] + (1,)) > DROP).astype(np.float32)
            grad, d_x, _ = net.backward(x, mask, label[part], weight[part] / len(part))
            turn += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
            net.learn_inputs(words, of[mask], d_x[mask])
    return net


def fit(docs: DataFrame, labels: DataFrame, positive: int = TRAIN_POSITIVE, negative: int = TRAIN_NEGATIVE) -> ToxicNet | None:
    """Train on a bounded sample of docs(doc_id, text) with labels(doc_id, toxic); None without both labels."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic): r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).where(F.col("toxic").isin(0, 1)).collect()}
    share = {k: min(1.0, most / max(1, counts.get(k, 0))) for k, most in ((1, positive), (0, negative))}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    chosen = F.broadcast(known.where(F.col("toxic").isin(0, 1) & drawn))  # positive + negative rows at most, about
    fitting = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_TEXT).join(chosen, "doc_id")
    total = fitting.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fewer = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1 << 20)) < int(min(1.0, TRAIN_BYTES / max(1, total)) * (1 << 20))
    rows = fitting.where(fewer).orderBy("doc_id", "text").select("text", "toxic").collect()
    label = np.array([r.toxic for r in rows])
    if not len(rows) or label.min() == label.max():
        return None
    return train([r.text.encode() for r in rows], label)


def score(docs: DataFrame, net: ToxicNet | None) -> DataFrame:
    """doc_id, held_out, score for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(texts_of(batch)) if shared.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(read, f"doc_id {type_of(docs, 'doc_id')}, held_out boolean, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, net).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

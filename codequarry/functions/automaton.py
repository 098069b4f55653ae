"""Many keywords in many texts at once: an Aho-Corasick automaton as arrays, run over Arrow batches.

Texts are cut into stretches that overlap by the longest keyword and advance side by side, a byte of each at a step, so a step is one look-up in a
table for thousands of stretches. Bytes that stand in no keyword share one column of the table. Matches are of bytes; as both sides are
UTF-8, they are matches of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of keywords in one automaton, bytes of a stretch, bytes of text that are run at once.
STATES, STRETCH, AT_ONCE = 1 << 20, 4096, 8 << 20


class Automaton:
    """Transitions of the keywords' trie with failures folded in, the keyword that ends at each state (-1 for none), and for each state the
    next shorter state at which a keyword ends."""

    def __init__(self, keywords: list[str]):
        self.keywords = keywords
        raws = [k.encode() for k in keywords]
        used = np.unique(np.frombuffer(b"".join(raws), dtype=np.uint8))
        self.column = np.zeros(256, dtype=np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.longest = max(map(len, raws), default=1)
        table = np.full((sum(map(len, raws)) + 1, len(used) + 1), -1, dtype=np.int32)
        self.own = np.full(len(table), -1, dtype=np.int32)
        size = 1
        for k, raw in enumerate(raws):
            state = 0
            for c in self.column[np.frombuffer(raw, dtype=np.uint8)].tolist():
                if table[state, c] < 0:
                    table[state, c] = size
                    size += 1
                state = int(table[state, c])
            if raw:
                self.own[state] = k
        self.own = self.own[:size]
        self.shorter = np.zeros(size, dtype=np.int32)
        fail = np.zeros(size, dtype=np.int32)
        queue = []
        root = table[0]
        queue += root[root > 0].tolist()
        root[root < 0] = 0
        for state in queue:  # grows while it is read: states by depth
            row, back = table[state], table[fail[state]]
            new = row >= 0
            fail[row[new]] = back[new]
            queue += row[new].tolist()
            row[~new] = back[~new]
            f = fail[state]
            self.shorter[state] = f if self.own[f] >= 0 else self.shorter[f]
        self.table = np.ascontiguousarray(table[:size])
        self.told = (self.own >= 0) | (self.shorter > 0)

    def matches(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, end (in bytes, exclusive) and keyword of every match, overlapping ones included, by text and end."""
        length = np.array([len(r) for r in raws], dtype=np.int64)
        lead = self.longest - 1
        step = max(1, min(STRETCH, int(length.max(initial=1))))
        parts = np.maximum(1, -(-length // step))
        text = np.repeat(np.arange(len(raws)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.frombuffer(b"".join(raws), dtype=np.uint8)
        begin = np.cumsum(length) - length
        start = part * step - lead  # where in its text a stretch begins; before the text stands no byte
        state, columns = np.zeros(len(text), dtype=np.int64), self.table.shape[1]
        flat, found = self.table.ravel(), []
        for i in range(step + lead):
            at = start + i
            inside = (at >= 0) & (at < length[text])
            byte = whole[np.where(inside, begin[text] + at, 0)] if len(whole) else np.zeros(len(text), dtype=np.uint8)
            state = flat[state * columns + np.where(inside, self.column[byte], 0)].astype(np.int64)
            if i >= lead:
                hit = np.flatnonzero(self.told[state])
                if len(hit):
                    found.append(np.stack((text[hit], at[hit] + 1, state[hit])))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        t, end, s = np.concatenate(found, axis=1)
        out = []
        while len(s):
            ends = self.own[s] >= 0
            out.append(np.stack((t[ends], end[ends], self.own[s[ends]])))
            s = self.shorter[s].astype(np.int64)
            on = s > 0
            t, end, s = t[on], end[on], s[on]
        t, end, k = np.concatenate(out, axis=1)
        order = np.lexsort((k, end, t))
        return t[order], end[order], k[order]

    def contained(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text and keyword, once each, sorted."""
        t, _, k = self.matches(raws)
        both = np.unique(t * len(self.keywords) + k)
        return both // max(1, len(self.keywords)), both % max(1, len(self.keywords))


def _portions(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(raws):
        end, size = begin + 1, len(raws[begin])
        while end < len(raws) and size + len(raws[end]) <= AT_ONCE:
            size += len(raws[end])
            end += 1
        yield begin, end
        begin = end


def with_keywords(rows: DataFrame, column: str, keywords: list[str], into: str) -> DataFrame:
    """rows with `into`, the different keywords that the text in `column` contains, in the list's order; empty for null and for none. The list
    is as large as the caller's, and broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(Automaton(list(dict.fromkeys(k for k in keywords if k))))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        words = pa.array(automaton.keywords, pa.string())
        for batch in batches:
            raws = [r or b"" for r in batch.column(column).cast(pa.binary()).to_pylist()]
            counts, found = np.zeros(len(raws), dtype=np.int64), []
            for a, b in _portions(raws):
                text, keyword = automaton.contained(raws[a:b])
                counts[a:b] = np.bincount(text, minlength=b - a)
                found.append(keyword)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, words.take(pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.StringType()))]))


def keyword_pairs(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """id, keyword: which of keywords(keyword) stand in each of texts(id, text). Keywords are dealt over as many automata as their bytes need,
    each of which passes over the texts once, so any number of keywords is tried."""
    distinct = keywords.select("keyword").where("keyword <> ''").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // STATES))
    out = None
    for part in range(parts):
        some = [r.keyword for r in distinct.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part).collect()]
        found = with_keywords(texts.select("id", "text"), "text", sorted(some), "keywords").select("id", F.explode("keywords").alias("keyword"))
        out = found if out is None else out.unionByName(found)
    return out

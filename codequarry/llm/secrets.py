"""Secret scan: fixed credential patterns, and automata inferred from the credentials they label.

The values that the fixed patterns find in a bounded sample of texts are the labelled credentials;
other tokens of the sample are the counter-examples, those with a digit apart from those without. From each label a prefix tree is built
whose statistically compatible states are merged (ALERGIA: Hoeffding test on stop and transition
frequencies, recursively), which leaves a small probabilistic automaton. Every other candidate
of every whole text, that is every run of credential characters beside the fixed patterns' spans, is then
scored by the likelihood of its format under the best credential automaton against that under the best of the
counter-examples. Likely ones become spans of kind `format`: their advantage must be clear per character, and as a whole
outweigh how rare credentials are among tokens. The fixed patterns' spans always stay.

Defined results: null and empty text have no spans; repeated rows get equal spans; spans that begin at one
place are ordered by kind; without any labelled credential only the fixed patterns speak; an empty table gives no
rows; other columns are ignored. Scans are linear in the text's length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import discard, durable, portions, table, texts_of, type_of, word_hashes
from codequarry.llm.spans import SPAN_TYPE, SPANS, count_of, joined, of_kinds, ordered, to_code_points

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "format")
#: Labels of the counter-examples: tokens without a digit and with one.
COUNTER = ("word", "figure")

# The patterns of the contract, over UTF-8 bytes; the first is applied to text whose A-Z are lowered.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f](?<![0-9a-f][0-9a-f])[0-9a-f]{23,}+")

#: Candidates are maximal runs of credential characters of this length at least, as the fixed patterns ask of a value.
CANDIDATE_MIN = 6
#: Rows that the automata are learnt from, chosen by a hash of the id; values of each label, chosen by hash.
TRAIN_ROWS, TRAIN_VALUES = 50_000, 600
#: Characters of a value that enter a prefix tree; of a longer one the beginning does, without an end (it is scored as a whole).
TREE_DEPTH = 200
#: Confidence of the Hoeffding test, and the log-likelihood advantage per character and as a whole that make a candidate a secret.
MERGE_ALPHA, ADVANTAGE, EVIDENCE = 0.05, 0.35, 14.0
#: Bytes of text whose candidates are scored at once, and the length from which a candidate is scored on its own.
BYTES_AT_ONCE, LONG = 1 << 20, 512

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_GAP = np.ones(256, dtype=bool)
_GAP[list(_ALPHABET)] = False
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True


def base_spans(raw: bytes) -> list[tuple[str, int, int, float]]:
    """Byte spans of the fixed patterns. An assignment with a short value is dropped, and the scan goes on after it."""
    found = [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(raw)]
    found += [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(raw)]
    return found


class Texts:
    """Several texts in one array: the fixed patterns' spans of each, and the candidates between them as byte ranges of the array."""

    def __init__(self, raws: list[bytes]):
        self.base = [base_spans(raw) for raw in raws]
        self.raw = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8).copy()
        self.begin = np.cumsum([0] + [len(r) + 1 for r in raws])
        for at, spans in zip(self.begin.tolist(), self.base):
            for _, s, e, _ in spans:
                self.raw[at + s : at + e] = 10
        free = ~_GAP[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        long = edge[1::2] - edge[0::2] >= CANDIDATE_MIN
        self.start, self.end = edge[0::2][long], edge[1::2][long]


class Automaton:
    """Deterministic probabilistic automaton, as matrices of states by bytes: the next state and the log probability of going there;
    and the log probability to stop. A byte that a state has not seen costs its smoothed share and stays in the state."""

    def __init__(self, steps: list[dict[int, tuple[int, float]]], stops: list[float], unseen: list[float]):
        self.next = np.repeat(np.arange(len(steps), dtype=np.int32)[:, None], 256, axis=1)
        self.gain = np.repeat(np.array(unseen)[:, None], 256, axis=1)
        self.stops = np.array(stops)
        for state, row in enumerate(steps):
            for byte, (to, gain) in row.items():
                self.next[state, byte], self.gain[state, byte] = to, gain

    def log_likelihood(self, value: bytes) -> float:
        """Of one value, byte by byte."""
        rows, gains, at, total = self.next.tolist(), self.gain.tolist(), 0, 0.0
        for b in value:
            total += gains[at][b]
            at = rows[at][b]
        return total + float(self.stops[at])

    def log_likelihoods(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the values raw[start:end], which advance together, a byte at a time; the longest come first, so those still going are a prefix."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        begin, left = start[order], np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        state, total = np.zeros(len(order), dtype=np.int32), np.zeros(len(order))
        for k, going in enumerate(left.tolist()):
            b = raw[begin[:going] + k]
            total[:going] += self.gain[state[:going], b]
            state[:going] = self.next[state[:going], b]
        out = np.empty(len(order))
        out[order] = total + self.stops[state]
        return out


def infer(values: list[bytes], alpha: float = MERGE_ALPHA) -> Automaton:
    """Build the prefix tree of the values and merge compatible states, red-blue order, by level."""
    kids: list[dict[int, int]] = [{}]
    used: list[dict[int, int]] = [{}]
    seen, ends = [0], [0]
    for value in sorted(values):
        at = 0
        seen[0] += 1
        for b in value[:TREE_DEPTH]:
            if b not in kids[at]:
                kids[at][b] = len(kids)
                for column, empty in ((kids, {}), (used, {}), (seen, 0), (ends, 0)):
                    column.append(empty)
            used[at][b] = used[at].get(b, 0) + 1
            at = kids[at][b]
            seen[at] += 1
        ends[at] += len(value) <= TREE_DEPTH
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if differ(ends[p], seen[p], ends[q], seen[q]):
                return False
            for x in used[p].keys() | used[q].keys():
                if differ(used[p].get(x, 0), seen[p], used[q].get(x, 0), seen[q]):
                    return False
                if x in used[p] and x in used[q]:
                    todo.append((kids[p][x], kids[q][x]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the counts of the subtree b to the states from a on; where a has no such branch, b's is hung in."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            seen[p] += seen[q]
            ends[p] += ends[q]
            for x, n in used[q].items():
                used[p][x] = used[p].get(x, 0) + n
                if x in kids[p]:
                    todo.append((kids[p][x], kids[q][x]))
                else:
                    kids[p][x] = kids[q][x]

    red = [0]
    while True:
        blue = next(((r, x) for r in red for x in sorted(kids[r]) if kids[r][x] not in red), None)
        if blue is None:
            break
        parent, x = blue
        node = kids[parent][x]
        into = next((r for r in red if compatible(r, node)), None)
        if into is None:
            red.append(node)
        else:
            kids[parent][x] = into
            fold(into, node)
    name = {r: i for i, r in enumerate(red)}
    weight = [seen[r] + 0.5 * (len(_ALPHABET) + 1) for r in red]
    return Automaton(
        [{x: (name[kids[r][x]], math.log((n + 0.5) / w)) for x, n in used[r].items()} for r, w in zip(red, weight)],
        [math.log((ends[r] + 0.5) / w) for r, w in zip(red, weight)],
        [math.log(0.5 / w) for w in weight],
    )


class SecretModel:
    """Automata by credential label, and those of the counter-examples."""

    def __init__(self, automata: dict[str, Automaton]):
        self.labels = [a for k, a in automata.items() if k not in COUNTER]
        self.others = [a for k, a in automata.items() if k in COUNTER]

    def advantages(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood advantage of the best credential automaton for the values raw[start:end]; -inf without one."""
        if not self.labels or not len(start):
            return np.full(len(start), -np.inf)
        out, short = np.empty(len(start)), end - start < LONG
        of = lambda a: a.log_likelihoods(raw, start[short], end[short])
        against = np.max([of(a) for a in self.others], axis=0) if self.others else -(end - start)[short] * math.log(len(_ALPHABET))
        out[short] = np.max([of(a) for a in self.labels], axis=0) - against
        for k in np.flatnonzero(~short).tolist():
            out[k] = self.advantage(raw[start[k] : end[k]].tobytes()) * (end[k] - start[k])
        return out

    def advantage(self, value: bytes) -> float:
        """The same of one value, per character."""
        if not self.labels:
            return -math.inf
        against = max((a.log_likelihood(value) for a in self.others), default=-len(value) * math.log(len(_ALPHABET)))
        return (max(a.log_likelihood(value) for a in self.labels) - against) / len(value)


def _labelled(most: int):  # noqa: ANN202
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """label, value, h: different values of each label in a batch, the `most` with the smallest hashes. Values are stated up to one
        byte beyond what a tree takes."""
        for batch in batches:
            found: dict[str, dict[bytes, int]] = {k: {} for k in (*BASE_KINDS, *COUNTER)}
            raws = texts_of(batch)
            for a, b in portions(raws, BYTES_AT_ONCE):
                texts = Texts(raws[a:b])
                for raw, spans in zip(raws[a:b], texts.base):
                    for kind, s, e, _ in spans:
                        value = raw[s:e]
                        if kind == "assign":
                            m = ASSIGN.match(value.lower())
                            value = value[m.start(2) : m.end(2)]
                        found[kind][value[: TREE_DEPTH + 1]] = 0
                h, start, end = word_hashes(texts.raw, lower=False, gaps=_GAP)
                digits = np.concatenate(([0], np.cumsum(_DIGIT[texts.raw])))
                long, figure = end - start >= CANDIDATE_MIN, digits[end] > digits[start]
                for kind, own in zip(COUNTER, (long & ~figure, long & figure)):
                    first = np.unique(h[own], return_index=True)[1][:most]
                    for s, e in zip(start[own][first].tolist(), end[own][first].tolist()):
                        found[kind][texts.raw[s : min(e, s + TREE_DEPTH + 1)].tobytes()] = 0
            rows = []
            for kind, values in found.items():
                for value in values:
                    values[value] = int(word_hashes(np.frombuffer(value, dtype=np.uint8), lower=False, gaps=_GAP)[0][0])
                rows += [(kind, v.decode(), h) for v, h in sorted(values.items(), key=lambda x: (x[1], x[0]))[:most]]
            kind, value, h = zip(*rows) if rows else ((), (), ())
            hashes = np.array(h, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(hashes)], ["label", "value", "h"])

    return label


def learn(docs: DataFrame, max_rows: int = TRAIN_ROWS, max_values: int = TRAIN_VALUES) -> SecretModel:
    """Automata from a bounded sample of docs(doc_id, text). Labelled values are distinct, and chosen by their hash. The sample is
    scanned once; of what the batches tell, each label's values are taken from a small table."""
    share = min(1.0, max_rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    values = durable(sample.mapInArrow(_labelled(max_values), "label string, value string, h long").distinct())
    automata = {}
    for label in (*BASE_KINDS, *COUNTER):
        rows = values.where(F.col("label") == label).orderBy("h", "value").limit(max_values)
        kept = [r.value.encode() for r in rows.select("value").collect()]
        if kept:
            automata[label] = infer(kept)
    discard(values)
    return SecretModel(automata)


def find_secrets(docs: DataFrame, model: SecretModel, advantage: float = ADVANTAGE, evidence: float = EVIDENCE) -> DataFrame:
    """doc_id and the ordered spans of each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, found = texts_of(batch), []
            for a, b in portions(raws, BYTES_AT_ONCE):
                texts = Texts(raws[a:b])
                gain = shared.value.advantages(texts.raw, texts.start, texts.end)
                per = gain / np.maximum(1, texts.end - texts.start)
                hit = np.flatnonzero((per >= advantage) & (gain >= evidence))
                owner = np.searchsorted(texts.begin, texts.start[hit], side="right") - 1
                more: dict[int, list] = {}
                for k, own in zip(hit.tolist(), owner.tolist()):
                    at = int(texts.begin[own])
                    more.setdefault(own, []).append(("format", int(texts.start[k]) - at, int(texts.end[k]) - at, float(per[k])))
                for k, raw in enumerate(raws[a:b]):
                    found.append(ordered(to_code_points(raw, texts.base[k] + more.get(k, [])), KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {type_of(docs, 'doc_id')}, spans {SPANS}")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, learn(docs))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of_kinds(spans, BASE_KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        count_of(spans, "format").alias("n_format"),
    )

"""Personal data: fixed patterns, and terms that give the protected values away.

Mails, addresses, card and phone numbers are found by fixed patterns; each distinct value is a
protected entity. Over the whole corpus it is then estimated how strongly the other terms of the texts that hold
an entity reveal it: with p(e) and p(t) the shares of different texts that hold e and t, the disclosure of e by t is
the share of e's information -log p(e) that t supplies, 1 + log p(e|t) / -log p(e). A term and an entity occur together when one
text holds both, at any distance. Most entities stand in a single text, so p(e|t) is smoothed by one more text
that holds t without e: together / (n + 1). A term whose disclosure reaches the threshold becomes a span of kind
`term` wherever it stands in the texts that hold the entity, and `sanitise` generalises or removes it along with the entity.

Only texts that hold an entity give terms. In how many texts of the corpus these occur is counted in a
second pass that drops terms outside a Bloom filter of fixed size; what passes wrongly finds no partner in the
join, so counts are exact. Entities that stand in the same set of texts can't be told apart by co-occurrence and
count as one, and terms in more texts than an entity's information allows are dropped before they are paired with it.

A text that holds a term without the entity keeps it: with entities of single texts and words of few texts, treating a term
wherever it occurs would cut rare words out of most clean texts of a large corpus.

Defined results: null and empty texts have no spans; repeated rows get equal spans; copies of one
text count as one text of evidence; ties go by kind and end; an empty table gives no rows; other columns are ignored,
and sanitise() hands them on. Scans are linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import durable, key_filter, passes, pieces, portions, sided, table, texts_of, type_of, unused, word_hashes
from codequarry.llm.spans import SPAN_TYPE, SPANS, count_of, joined, of_kinds, ordered

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "term")

# The patterns of the contract, over UTF-8 bytes, written so that a scan never goes back.
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")
_LOCAL = np.zeros(256, dtype=bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True

#: Share of an entity's information that a term may supply.
DISCLOSURE = 0.8
#: Bytes of text whose words are counted at once.
BYTES_AT_ONCE = 1 << 20
#: Rows of a small side that may be broadcast, and spans of the side that holds them (some 64 bytes each).
BROADCAST_ROWS, BROADCAST_SPANS = 50_000, 1_000_000


def _emails(raw: bytes) -> list[tuple[int, int]]:
    out, done, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > done and _LOCAL[raw[start - 1]]:
            start -= 1
        m = DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = raw.find(b"@", max(done, at + 1))
    return out


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple[str, int, int, float]]:
    """Byte spans of the fixed patterns; a match that fails its test is dropped, and the scan goes on after it."""
    found = [("email", s, e, 1.0) for s, e in _emails(raw)]
    if not _DIGIT.search(raw):
        return found
    found += [("ip", m.start(), m.end(), 1.0) for m in IP.finditer(raw) if all(len(v := p.lstrip(b"0")) <= 3 and int(v or b"0") <= 255 for p in m[0].split(b"."))]
    for m in CARD.finditer(raw):
        digits = m[0].translate(None, b" -")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end(), 1.0))
    found += [("phone", m.start(), m.end(), 1.0) for m in PHONE.finditer(raw) if 9 <= len(m[0].translate(None, b"+ ().-")) <= 15]
    return found


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _entity(raw: bytes, kind: str, s: int, e: int) -> int:
    value = np.frombuffer(kind.encode() + b":" + raw[s:e].replace(b" ", b"_"), dtype=np.uint8)
    return int(_signed(word_hashes(value)[0])[0])


def _terms(arr: np.ndarray, spans: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words that are no part of an entity; spans are those of base_spans()."""
    words, starts, ends = word_hashes(arr)
    apart = np.ones(len(words), dtype=bool)
    for _, s, e, _ in spans:
        apart[np.searchsorted(ends, s, side="right") : np.searchsorted(starts, e, side="left")] = False
    return _signed(words[apart]), starts[apart], ends[apart]


def _before(raw: bytes, arr: np.ndarray) -> np.ndarray | None:
    """Code points before each byte, or None where they are the bytes."""
    return None if raw.isascii() else np.concatenate(([0], np.cumsum((arr & 0xC0) != 0x80)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found, entities, terms = [], [], []
        for raw in texts_of(batch):
            spans = base_spans(raw)
            held, words = [], np.zeros(0, dtype=np.int64)
            if spans:
                arr = np.frombuffer(raw, dtype=np.uint8)
                held = sorted({_entity(raw, k, s, e) for k, s, e, _ in spans})
                words = np.unique(_terms(arr, spans)[0])
                before = _before(raw, arr)
                if before is not None:
                    spans = [(k, int(before[s]), int(before[e]), x) for k, s, e, x in spans]
            found.append(ordered(spans, KINDS))
            entities.append(held)
            terms.append(words)
        lists = pa.list_(pa.int64())
        made = [pa.array(found, SPAN_TYPE), pa.array(entities, lists), pa.array(terms, lists)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "key", "same")] + made, ["doc_id", "key", "same", "spans", "entities", "terms"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the telling terms wherever they stand in the text."""
    for batch in pieces(batches):
        out = []
        for raw, telling, scores in zip(texts_of(batch), batch.column("telling").to_pylist(), batch.column("scores").to_pylist()):
            arr = np.frombuffer(raw, dtype=np.uint8)
            t, starts, ends = _terms(arr, base_spans(raw))
            order = np.argsort(telling)
            known, score = np.asarray(telling, dtype=np.int64)[order], np.asarray(scores, dtype=float)[order]
            at = np.minimum(np.searchsorted(known, t), len(known) - 1)
            hit = known[at] == t
            before = _before(raw, arr)
            if before is not None:
                starts, ends = before[starts], before[ends]
            out.append([{"kind": "term", "start": int(a), "end": int(b), "score": float(x)} for a, b, x in zip(starts[hit], ends[hit], score[at[hit]])])
        yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(out, SPAN_TYPE)], ["same", "found"])


def _term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """t, n: different texts that hold the word, for a superset of terms(t). texts(text, copies) has each row's number of equal texts."""
    shared = texts.sparkSession.sparkContext.broadcast(key_filter(terms))

    def portion(raws: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, starts, _ = word_hashes(np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8))
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
        t = _signed(words)
        ok = passes(shared.value, t)
        t, owner = t[ok], owner[ok]
        order = np.lexsort((owner, t))
        t, owner = t[order], owner[order]
        once = np.concatenate(([True], (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])))[: len(t)]
        t, share = t[once], 1.0 / copies[owner[once]]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))[: len(t)]
        return t[first], np.add.reduceat(share, first) if len(t) else share

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, copies = texts_of(batch), batch.column("copies").to_numpy()
            told = [portion(raws[a:b], copies[a:b]) for a, b in portions(raws, BYTES_AT_ONCE)]
            t, where = np.unique(np.concatenate([x for x, _ in told]) if told else np.zeros(0, np.int64), return_inverse=True)
            n = np.bincount(where, np.concatenate([x for _, x in told]) if told else None, len(t))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n.astype(float))], ["t", "n"])

    counted = texts.select("text", "copies").mapInArrow(count, "t long, n double")
    return counted.groupBy("t").agg(F.round(F.sum("n")).cast("long").alias("n"))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, key (hash of id and text) and ordered spans, one row for each row of docs(doc_id, text)."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("same"))
    shape = f"doc_id {type_of(docs, 'doc_id')}, key long, same long, spans {SPANS}, entities array<long>, terms array<long>"
    found = durable(keyed.mapInArrow(_extract, shape))
    # copies of one text show the same terms: evidence must come from different texts
    copies = durable(found.groupBy("same").agg(F.count("*").alias("copies")))
    total = copies.count() + 1
    again = copies.where("copies > 1")
    texts = keyed.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "same", "left")
    holding = durable(found.where(F.size("entities") > 0).select("same", "entities", "terms").dropDuplicates(["same"]))
    held = holding.select("same", F.explode("entities").alias("e"))
    sets = held.groupBy("e").agg(F.count("*").alias("holds"), F.bit_xor(F.xxhash64("same")).alias("set"))
    # together <= holds, so a term in more texts than this can't supply enough
    most = F.col("holds") * F.pow(F.lit(float(total)) / F.col("holds"), F.lit(1 - disclosure))
    groups = durable(held.join(sets, "e").select("same", "set", "holds", most.alias("most")).distinct())
    widest = groups.groupBy("same").agg(F.max("most").alias("widest"))
    shown = holding.join(widest, "same").select("same", "widest", F.explode("terms").alias("t"))
    counts = _term_counts(texts.select("text", F.coalesce("copies", F.lit(1)).alias("copies")), shown.select("t").distinct())
    counts = sided(counts.where(F.col("n") + 1 <= (groups.agg(F.max("most")).first()[0] or 0.0) + 1e-6), BROADCAST_ROWS)
    rare = shown.join(counts, "t").where(F.col("n") + 1 <= F.col("widest") + 1e-6).select("same", "t", "n")
    pairs = durable(rare.join(groups, "same").where(F.col("n") + 1 <= F.col("most") + 1e-6).select("same", "set", "holds", "t", "n"))
    supplied = 1 + F.log(F.col("together") / (F.col("n") + 1)) / -F.log(F.col("holds") / F.lit(float(total)))
    telling = pairs.groupBy("set", "holds", "t", "n").agg(F.count("*").alias("together")).where(supplied >= disclosure).select("set", "t", supplied.alias("score"))
    best = pairs.select("same", "set", "t").join(telling, ["set", "t"]).groupBy("same", "t").agg(F.max("score").alias("score"))
    listed = F.collect_list(F.struct("t", "score"))
    named = durable(best.groupBy("same").agg(listed.alias("l")).select("same", F.col("l.t").alias("telling"), F.col("l.score").alias("scores")))
    with_terms = keyed.join(sided(named.select("same")), "same", "left_semi").groupBy("same").agg(F.first("text").alias("text"))
    terms = with_terms.join(named, "same").mapInArrow(_place, f"same long, found {SPANS}").withColumnRenamed("found", "terms")
    rank = F.array(*(F.lit(k) for k in KINDS))

    def place(s):  # noqa: ANN001, ANN202
        return F.struct(
            s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
            s["score"].alias("score")
        )

    both = F.array_sort(F.transform(F.concat("spans", F.coalesce("terms", F.array().cast(SPANS))), place))
    return found.drop("terms").join(terms, "same", "left").select(
        "doc_id", "key",
        F.transform(
            both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))
        ).alias("spans")
    )


def _cleaned(text: str, spans: list) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] < at:
            continue
        word = text[s["start"] : s["end"]]
        out.append(text[at : s["start"]])
        if s["kind"] != "term":
            out.append(f"[{s['kind'].upper()}]")
        elif any(c.isdigit() for c in word):
            out.append("[NUMBER]")
        elif word[:1].isupper():
            out.append("[NAME]")
        at = s["end"]
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **options: float) -> DataFrame:
    """docs with text cleaned: entities and telling terms with digits or a capital are generalised to a
    bracketed class, other telling terms are removed. Rows and other columns stay as they are."""
    found = find_personal_data(docs, **options).where(F.size("spans") > 0).dropDuplicates(["key"])
    key, own = unused("key", docs.columns), unused("spans", docs.columns)
    spans = sided(found.select(F.col("key").alias(key), F.col("spans").alias(own)), BROADCAST_SPANS, F.size(own))
    columns, place = docs.columns, docs.columns.index("text")
    marked = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(spans, key, "left").select(*columns, own)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [_cleaned(t, s) if s and t else t for t, s in zip(batch.column(place).to_pylist(), batch.column(own).to_pylist())]
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return marked.mapInArrow(clean, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return find_personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of_kinds(spans, BASE_KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        count_of(spans, "term").alias("n_term"),
    )

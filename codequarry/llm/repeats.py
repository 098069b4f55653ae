"""Suffix-array dedup: remove every byte covered by a string of SPAN bytes that starts anywhere else.

Sorting the suffixes of a whole corpus in one array would not distribute, so suffixes are compared where they can
be equal. Every string of SPAN bytes has an anchor, the substring of ANCHOR bytes with the smallest hash in
it; equal strings have equal anchors at equal offsets. A corpus has about one anchor in 50 bytes. Anchors that occur
once rule out all strings they stand for; the others' surroundings (the bytes of the strings they stand for) are
collected. Equal surroundings repeat as a whole. Where an anchor has several different ones, these
are written behind each other, with one symbol for the anchor, and their suffixes are sorted by the linear grouping
construction (suffixes.py): a string repeats if its suffix shares its whole length with a neighbour in the order.
An anchor with more than LIMIT different surroundings is not sorted in one task. Its strings are divided by the offset at
which they hold the anchor, in ranges of WIDTHS; strings of a range share the bytes that all of them must hold, which
makes smaller groups. What is still too large is divided again, down to single strings, which are counted.

Texts are told apart by a 64-bit hash, and so are anchors. Copies of a text are looked at once: each byte of a text
of SPAN bytes or more that has a copy is removed.

Defined results: null and empty texts have no bytes; shorter texts than SPAN keep all; repeated rows are copies of each
other (also under one id); null ids are kept as rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import _BYTE_CODE, discard, durable, key_filter, mix64, passes, portions, powers, table, texts_of
from codequarry.llm.suffixes import common_prefixes, suffix_array

SPAN, ANCHOR = 200, 100
#: Different surroundings of an anchor that one task sorts, and symbols that are sorted in one array.
LIMIT, SYMBOLS = 2_000, 60_000
#: Ranges of offsets into which the strings of a group that is too large are divided, in turn; the last are single strings.
WIDTHS = (26, 7, 1)
#: Surroundings that a task sorts, about.
ROWS_A_TASK = 2_000
#: Places that a batch sends to an anchor's task; if it has more, those are known to repeat and go elsewhere.
SENT = 2
#: Bytes of text whose anchors are found at once; a longer text is read in slices of so many, which overlap by a string.
BYTES_AT_ONCE, SLICE = 1 << 19, 1 << 23
#: Low bits of a hash that give way to a position when the smallest is sought; more than a slice has bytes.
POSITION_BITS = 24

_REACH = SPAN - ANCHOR
_U = np.uint64
_INVERSE = [np.ones(1, dtype=_U)]


def _inverse_powers(n: int) -> np.ndarray:
    if len(_INVERSE[0]) <= n:
        p = np.full(max(n + 1, 1 << 16), _U(pow(0x9E3779B97F4A7C15, -1, 2**64)), dtype=_U)
        p[0] = 1
        _INVERSE[0] = np.multiply.accumulate(p)
    return _INVERSE[0]


def substring_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n bytes in a row."""
    if len(raw) < n:
        return np.zeros(0, dtype=_U)
    total = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(_BYTE_CODE[raw] * powers(len(raw))[: len(raw)], dtype=_U)))
    return mix64((total[n:] - total[:-n]) * _inverse_powers(len(raw))[: len(raw) - n + 1])


def anchors(raw: np.ndarray, bounds: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the texts raw[a:b]: the text's place in bounds, and its anchors' hashes, positions in the text, and the smallest
    and largest offset at which a string that has this anchor holds it. Ties go to the leftmost."""
    h = substring_hashes(raw, ANCHOR)
    wide = _REACH + 1
    if len(h) < wide:
        return
    bits = POSITION_BITS
    key = (h >> _U(bits) << _U(bits)) | np.arange(len(h), dtype=_U)
    blocks = -(-len(key) // wide)
    padded = np.full(blocks * wide, ~_U(0), dtype=_U)
    padded[: len(key)] = key
    padded = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(h) - wide + 1
    best = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & _U((1 << bits) - 1)).astype(np.int64)
    for k, (a, b) in enumerate(bounds):
        if b - a < SPAN:
            continue
        at = best[a : b - SPAN + 1]
        cut = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
        p = at[first]
        yield k, h[p], p - a, p - (a + last), p - (a + first)


def _slices(raws: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], list[int], list[int]]]:
    """Bytes of several texts, or of a slice of a long one; the ranges of the texts in them, the texts' places and where in its
    text each range begins. Every string of SPAN bytes lies in exactly one slice."""
    for begin, end in portions(raws, BYTES_AT_ONCE):
        some = raws[begin:end]
        if len(some) > 1 or len(some[0]) <= SLICE:
            at = np.cumsum([0] + [len(r) for r in some]).tolist()
            yield np.frombuffer(b"".join(some), dtype=np.uint8), list(zip(at[:-1], at[1:])), list(range(begin, end)), [0] * len(some)
            continue
        for base in range(0, len(some[0]) - SPAN + 1, SLICE):
            piece = some[0][base : base + SLICE + SPAN - 1]
            yield np.frombuffer(piece, dtype=np.uint8), [(0, len(piece))], [begin], [base]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, anchor, tid, at (position, smallest and largest offset in one number); a text that repeats in the batch is passed
    over. An anchor's first SENT places in the batch are keyed by the anchor, which is then not stated again; further ones surely
    repeat and are keyed by chance, so that a frequent anchor is dealt out."""
    for batch in batches:
        tids, first = np.unique(batch.column("tid").to_numpy(), return_index=True)
        raws = texts_of(batch.take(pa.array(first)))
        out = []
        for raw, bounds, places, bases in _slices(raws):
            found = list(anchors(raw, bounds))
            if found:
                k, h, p, lo, hi = zip(*found)
                size = [len(x) for x in h]
                tid, base = np.repeat(tids[np.array(places)[list(k)]], size), np.repeat(np.array(bases)[list(k)], size)
                out.append((np.concatenate(h).view(np.int64), tid, (np.concatenate(p) + base << 16) | (np.concatenate(lo) << 8) | np.concatenate(hi)))
        if not out:
            continue
        anchor, tid, at = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(anchor, kind="stable")
        ranked = anchor[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        turn = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
        sure = np.empty(len(anchor), dtype=bool)
        sure[order] = turn >= SENT
        chance = mix64(tid.view(_U) ^ mix64(at.astype(_U))).view(np.int64)
        columns = [pa.array(np.where(sure, chance, anchor)), pa.array(anchor, mask=~sure), pa.array(tid), pa.array(at)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "anchor", "tid", "at"])


def _texts(keyed: DataFrame, needed: DataFrame) -> DataFrame:
    """tid, text of the texts of needed(tid), and few others: a filter of fixed size over the tids picks them."""
    shared = keyed.sparkSession.sparkContext.broadcast(key_filter(needed))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, first = np.unique(batch.column("tid").to_numpy(), return_index=True)
            yield batch.take(pa.array(first[passes(shared.value, tids)]))

    return keyed.select("tid", "text").mapInArrow(pick, "tid long, text string").dropDuplicates(["tid"])


def _surround(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """anchor, look (hash of the surroundings), tid, at, left, right: bytes before and after the anchor. Where a
    batch has surroundings twice, the bytes stand in one row."""
    for pdf in batches:
        rows: list[tuple] = []
        seen = set()
        for tid, text, found in zip(pdf["tid"], pdf["text"], pdf["found"]):
            raw = text.encode()
            for x in found:
                anchor, at = x["anchor"], x["at"]
                p, lo, hi = at >> 16, at >> 8 & 255, at & 255
                left, right = raw[p - hi : p], raw[p + ANCHOR : p - lo + SPAN]
                look = int.from_bytes(hashlib.blake2b(left + b"|" + right + bytes((lo, hi)), digest_size=8).digest(), "little", signed=True)
                new = (anchor, look) not in seen
                seen.add((anchor, look))
                rows.append((anchor, look, tid, at, left if new else None, right if new else None))
        yield pd.DataFrame(rows, columns=["anchor", "look", "tid", "at", "left", "right"])


def repeated_offsets(groups: list[tuple[int, list[tuple[bytes, bytes]]]]) -> list[list[list[bool]]]:
    """For each anchor with its different surroundings (left, right): for each of those, for every offset from len(left) down to
    the smallest, whether that string occurs in another one or again in its own. One suffix array serves all anchors."""
    text: list[int] = []
    begins: list[list[int]] = []
    for k, (_, around) in enumerate(groups):
        begins.append([])
        for left, right in around:
            begins[-1].append(len(text))
            text += [x + 2 for x in left]
            text.append(258 + k)
            text += [x + 2 for x in right]
            text.append(1)
    text.append(0)
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    least = _REACH + 1
    twice = bytearray(len(text))
    for i in range(1, len(order)):
        if shared[i] >= least:
            twice[order[i]] = twice[order[i - 1]] = 1
    return [[[bool(twice[b + i]) for i in range(len(left) + len(right) - _REACH + 1)] for b, (left, right) in zip(at, around)] for at, (_, around) in zip(begins, groups)]


def _runs(flags: list[bool], hi: int) -> list[dict]:
    """Offsets whose strings repeat, as inclusive ranges; flags go from offset hi down."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [{"hi": hi - a, "lo": hi - b + 1} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]


RANGES = "array<struct<hi:int,lo:int>>"


def _sort_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows group, anchor, look, left, right with a group's rows together; out: anchor, look, ranges."""
    rest: pd.DataFrame | None = None

    def solve(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        queue: list[tuple[list, list, list]] = []
        size = 0

        def done() -> pd.DataFrame:
            flags = repeated_offsets([(k, around) for k, (around, _, _) in enumerate(queue)])
            rows = [(a, look, _runs(f, len(l))) for (around, names, looks), fs in zip(queue, flags) for (l, _), a, look, f in zip(around, names, looks, fs)]
            return pd.DataFrame([r for r in rows if r[2]], columns=["anchor", "look", "ranges"])

        group = pdf["group"].to_numpy()
        cut = np.flatnonzero(np.diff(group)) + 1
        left, right, names, looks = (pdf[c].tolist() for c in ("left", "right", "anchor", "look"))
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(group)]):
            around = list(zip(left[a:b], right[a:b]))
            queue.append((around, names[a:b], looks[a:b]))
            size += sum(len(x) + len(y) + 2 for x, y in around)
            if size >= SYMBOLS:
                yield done()
                queue, size = [], 0
        if queue:
            yield done()

    for pdf in batches:
        if rest is not None:
            pdf = pd.concat((rest, pdf))
        if not len(pdf):
            continue
        last = pdf["group"].to_numpy() == pdf["group"].iloc[-1]
        rest = pdf[last]
        if not last.all():
            yield from solve(pdf[~last])
    if rest is not None and len(rest):
        yield from solve(rest)


def _divided(rows: DataFrame, width: int) -> DataFrame:
    """rows(anchor, look, left, right), once for each range of offsets that they have strings in: cut to the bytes of those, with the
    group of rows whose strings may be equal."""
    most, least = F.octet_length("left"), _REACH - F.octet_length("right")
    parts = rows.withColumn("o", F.explode(F.sequence(F.floor(least / width), F.floor(most / width)))).withColumn("o", (F.col("o") * width).cast("int"))
    top = F.least(F.col("o") + (width - 1), F.lit(_REACH))
    tail = lambda n: F.expr("substring(left, octet_length(left) - o + 1, o)") if n is None else F.substring(
        F.col("left"), F.octet_length("left") - n + F.lit(1), n
    )
    need_right = (F.lit(_REACH) - top).cast("int")
    group = F.xxhash64("anchor", "o", tail(None), F.substring(F.col("right"), F.lit(1), need_right))
    own_top, own_low = F.least(top, most).cast("int"), F.greatest(F.col("o"), least).cast("int")
    return parts.select(
        group.alias("group"), "anchor", "look", tail(own_top).alias("left"),
        F.substring(F.col("right"), F.lit(1), (F.lit(_REACH) - own_low).cast("int")).alias("right")
    )


def _repeats(several: DataFrame, limit: int) -> DataFrame:
    """anchor, look, ranges of offsets whose strings repeat, for the different surroundings several(anchor, look, left, right). What is
    equal after a cut repeats as a whole, and one of it stands for all in what follows."""
    rows, found = several.select(F.xxhash64("anchor").alias("group"), "anchor", "look", "left", "right"), []
    for width in WIDTHS:
        size = durable(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
        few = size.where(F.col("n") <= limit)
        # sorting costs far more than its bytes tell, so the number of tasks follows the rows
        parts = max(12, min(20_000, few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // ROWS_A_TASK))
        ordered = rows.join(few.select("group"), "group").repartition(parts, "group").sortWithinPartitions("group")
        found.append(ordered.mapInPandas(_sort_groups, f"anchor long, look long, ranges {RANGES}"))
        many = size.where(F.col("n") > limit).select("group")
        if many.isEmpty():
            break
        cut = durable(_divided(rows.join(many, "group"), width))
        same = durable(cut.groupBy("group", "left", "right").agg(F.count("*").alias("n"), F.min(F.struct("anchor", "look")).alias("one")))
        whole = F.array(F.struct(F.octet_length("left").alias("hi"), (F.lit(_REACH) - F.octet_length("right")).alias("lo"))).cast(RANGES)
        twice = same.where("n > 1").select("group", "left", "right")
        found.append(cut.join(twice, ["group", "left", "right"]).select("anchor", "look", whole.alias("ranges")))
        rows = same.select("group", "one.anchor", "one.look", "left", "right")
    return reduce(DataFrame.union, found)


def repeated_starts(keyed: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """From keyed(tid, text) without copies counted: tid, starts (array of inclusive ranges of positions whose SPAN bytes
    also start elsewhere); and tid, text of at least those texts."""
    rows = keyed.mapInArrow(_find, "key long, anchor long, tid long, at long").repartition("key")
    place = F.xxhash64("tid", "at")  # both uses take the same columns, so that the shuffle is reused
    sure = F.max(F.col("anchor").isNotNull()).alias("sure")
    common = rows.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), sure).where("sure or lo <> hi").select("key")
    # a copy in another batch gives equal rows; those of one key fall together here, any others where a text's are gathered
    again = rows.join(common, "key").dropDuplicates(["key", "tid", "at"])
    again = durable(again.select(F.coalesce("anchor", "key").alias("anchor"), "tid", "at"))
    by_text = again.groupBy("tid").agg(F.collect_set(F.struct("anchor", "at")).alias("found"))
    texts = durable(_texts(keyed, by_text.select("tid")))
    around = durable(texts.join(by_text, "tid").mapInPandas(_surround, "anchor long, look long, tid long, at long, left binary, right binary"))
    discard(again)
    looks = around.groupBy("anchor", "look").agg(F.count("*").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    different = durable(looks)
    whole = F.array(F.struct(F.lit(_REACH).alias("hi"), F.lit(0).alias("lo"))).cast(RANGES)
    full = different.where("n > 1").select("anchor", "look", whole.alias("ranges"))
    flags = full.union(_repeats(different.select("anchor", "look", "left", "right"), limit))
    at = F.col("at")
    spots = around.select("anchor", "look", "tid", "at").join(flags, ["anchor", "look"]).select(
        "tid", F.shiftright(at, 16).alias("p"), F.shiftright(at, 8).bitwiseAND(255).alias("least"), at.bitwiseAND(255).alias("most"), F.explode("ranges").alias("r")
    )
    begin, end = F.col("p") - F.least("r.hi", "most"), F.col("p") - F.greatest("r.lo", "least")
    own = spots.select("tid", begin.cast("long").alias("a"), end.cast("long").alias("b")).where("a <= b")
    return own.groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("starts")), texts


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for tid, text, starts in zip(pdf["tid"], pdf["text"], pdf["starts"]):
            raw, out, done, spans, gone, end = text.encode(), [], 0, [], 0, -1
            for a, b in sorted((s["a"], s["b"] + SPAN) for s in starts):
                if a <= end:
                    spans[-1][1] = end = max(end, b)
                else:
                    spans.append([a, b])
                    end = b
            for a, b in spans:
                out.append(raw[done:a])
                gone, done = gone + b - a, b
            out.append(raw[done:])
            rows.append((tid, gone, len(spans), hashlib.sha256(b"".join(out)).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        yield pd.DataFrame(rows, columns=["tid", "n_removed", "n_spans", "kept_sha256", "spans"])


SHAPE = "array<struct<start:long,end:long>>"


def _told_apart(rows: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(.., sha, tid) and keyed(tid, text) with new tids for different texts that share one: their sha's hash."""
    clash = rows.select("tid", "sha").distinct().groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid", F.lit(True).alias("clash"))
    clash = durable(clash)
    if clash.isEmpty():
        return rows, keyed
    new = lambda sha: F.when(F.col("clash"), F.xxhash64(sha)).otherwise(F.col("tid"))
    rows = rows.join(clash, "tid", "left").withColumn("tid", new(F.col("sha"))).drop("clash")
    keyed = keyed.join(clash, "tid", "left").withColumn("tid", new(F.sha2("text", 256))).drop("clash")
    return durable(rows), keyed.select("tid", "text")


def remove_repeats(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans, one row for each row of docs(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = durable(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("tid")))
    keyed = docs.where(F.octet_length("text") >= SPAN).select(F.xxhash64("text").alias("tid"), "text")
    rows, keyed = _told_apart(rows, keyed)
    starts, texts = repeated_starts(keyed, limit)
    copies = rows.where(F.col("n_bytes") >= SPAN).groupBy("sha").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"), F.max("tid").alias("tid")).where("n > 1")
    none = F.lit(0).cast("long")
    everything = F.array(F.struct(none.alias("start"), F.col("n_bytes").alias("end"))).cast(SHAPE).alias("spans")
    all_gone = copies.select("tid", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), everything)
    cut = texts.join(starts, "tid").mapInPandas(_cut, f"tid long, n_removed long, n_spans long, kept_sha256 string, spans {SHAPE}")
    found = all_gone.union(cut.join(copies.select("tid"), "tid", "left_anti"))
    dealt = rows.join(found, "tid", "left")  # a text with very many copies is split by the adaptive planner
    return dealt.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast(SHAPE)).alias("spans"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")

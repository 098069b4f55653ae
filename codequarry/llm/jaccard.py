"""N-gram Jaccard join: which texts share nearly all of their word shingles, and the classes this links.

A text's set is its distinct word shingles (64-bit hashes). Texts with equal sets are one candidate from here on.

Tiles. Sets meet in tiles, sorted by size. Sets whose sizes are too different are skipped, and parity bitmaps bound the rest:
the bits in which two bitmaps differ are at most the size of the symmetric difference, which bounds the overlap from above. Sets
with a partner that passes are then joined with their sorted arrays, and pairs that pass are verified in the tile by exact
intersection, closest first, unless links found before already make them one class. So a tile tells each class it found once,
and not its pairs: what leaves a tile is at most a row a member, however many pairs pass.

Meetings. First every set meets those with the same least hash (a set is in one tile, groups that are too large are cut at
random). This joins most copies at little cost; the member with most links stands for its class and meets again as long as
groups had to be cut. What a meeting misses is left to the routing.

Routing. Under any total order of shingles, two sets that are similar enough share one of the first n - ceil(t n) + 1 shingles
of each. The order used puts frequent shingles last (counted over all texts, for the lowest ZONE of the hash range, where such
prefixes lie) and goes by hash otherwise; which shingles count as frequent changes the cost, never the result. Shingles whose
members are of one class already route nothing, and of shingles with the very same members one is kept. The members of a shingle
are a tile. A group that is too large is cut into size bands (a set stands in its own band and the next, so sets of comparable
size meet) and a band into parts, by class: parts of one large class never meet each other, all others meet in pairs. So
members of a large class are repeated only for the sets outside it that share the shingle.

Defined results: texts without words have empty sets and stand alone; texts with fewer words than a shingle are one shingle;
equal sets are linked; null ids count as larger than all others; repeated rows are linked; ties in size go by the set's hash,
which changes no class; an empty table gives no rows; extra columns are ignored, and keep_first() hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import discard, durable, key_filter, mix64, passes, portions, sided, table, texts_of, type_of, unused, window_hashes, word_hashes
from codequarry.llm.components import components

WORDS, PERCENT = 3, 90
#: Sets of up to LONG shingles that a tile may hold; a longer one counts as several.
TILE, LONG = 2048, 1024
#: Bits of a bitmap at most and at least; in between, a set of n shingles has at least n / 2 of them.
BITS, LEAST_BITS = 4096, 256
#: Shingles are counted in the lowest part of the hash range, this many times the share that prefixes take; how many of the most frequent (with so many texts) go last.
ZONE, HOT, HOT_TEXTS = 1.4, 65_536, 32
#: Least hashes of a set, one for each meeting at most.
MEETINGS = 3
#: Bytes of text that are hashed at once, pairs whose bitmaps are compared at once, and pairs verified between two looks at the classes.
BYTES_AT_ONCE, PAIRS_AT_ONCE, VERIFIED_AT_ONCE = 1 << 20, 1 << 19, 1024

_U = np.uint64


class Sets:
    """Shingle sets of several texts in one array: set k is grams[at[k]:at[k + 1]], sorted and distinct."""

    def __init__(self, raws: list[bytes], n: int = WORDS):
        words, starts, _ = word_hashes(np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
        windows = window_hashes(words, n)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                s = np.sort(windows[a : b - n + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                sets.append(window_hashes(words[a:b], b - a) if b > a else words[:0])
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.grams = np.concatenate(sets) if sets else words[:0]
        self.mixed = mix64(self.grams)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.grams[self.at[k] : self.at[k + 1]]

    def _reduce(self, op: np.ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), dtype=_U)
        full = self.size > 0
        if full.any():
            out[full] = op.reduceat(values, self.at[:-1][full])
        return out

    def digests(self) -> np.ndarray:
        """Identity of each set: 64 bits, of its size and the sum and the exclusive or of its elements' hashes."""
        both = self._reduce(np.add, self.mixed), self._reduce(np.bitwise_xor, mix64(self.grams ^ _U(0xABCDEF)))
        h = np.zeros(len(self.size), dtype=_U)
        for i, x in enumerate((*both, self.size.astype(_U))):
            h = mix64(h * _U(0x9E3779B97F4A7C15) + mix64(x ^ _U(i + 1)))
        return h.view(np.int64)

    def least(self) -> np.ndarray:
        """MEETINGS columns: the least of the elements' hashes under several orders."""
        orders = [_U((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64) for i in range(MEETINGS)]
        return np.stack([self._reduce(np.minimum, self.mixed * m) for m in orders], axis=1).view(np.int64)

    def bitmaps(self) -> list[bytes]:
        """Parity of the number of elements at each bit. The low bits of an element's hash choose the bit, so folding a bitmap,
        the exclusive or of its halves, gives that of half the length."""
        width = 2 ** np.ceil(np.log2(np.clip(self.size / 2, LEAST_BITS, BITS))).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(width)))
        bit = (self.mixed >> _U(33)).astype(np.int64) & np.repeat(width - 1, self.size)
        counts = np.bincount(np.repeat(begin[:-1], self.size) + bit, minlength=int(begin[-1]))
        packed = np.packbits((counts & 1).astype(bool))
        return [packed[a >> 3 : b >> 3].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


class Bitmaps:
    """Bitmaps of many rows, in a matrix for each length, each also folded to half its length."""

    def __init__(self, bits: list[bytes]):
        self.length = np.array([len(b) for b in bits], dtype=np.int64)
        self.row = np.zeros(len(bits), dtype=np.int64)
        self.whole: dict[int, np.ndarray] = {}
        for w in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == w)
            self.row[at] = np.arange(len(at))
            self.whole[w] = np.frombuffer(b"".join(bits[k] for k in at), dtype=_U).reshape(-1, w // 8)
        self.folded = {w: m[:, : w // 16] ^ m[:, w // 16 :] for w, m in self.whole.items() if w >= 16}

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the rows i and j differ, pair by pair. Bitmaps of one length are compared as they are, and with those
        of twice the length, folded; others are of sets of no comparable size (and get 0)."""
        out = np.zeros(len(i), dtype=np.int64)
        a, b = self.length[i], self.length[j]
        for w in self.whole:
            for x, y, here in ((i, j, (a == w) & (b == w)), (i, j, (a == w) & (b == 2 * w)), (j, i, (b == w) & (a == 2 * w))):
                at = np.flatnonzero(here)
                step = max(1, (1 << 24) // w)
                for k in range(0, len(at), step):
                    some = at[k : k + step]
                    other = self.whole[w] if int(self.length[y[some[0]]]) == w else self.folded[2 * w]
                    out[some] = np.bitwise_count(self.whole[w][self.row[x[some]]] ^ other[self.row[y[some]]]).sum(axis=1)
        return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _zone(percent: int) -> np.uint64:
    return _U(int(min(0.999, ZONE * (1 - percent / 100)) * 2**64))


def _hot_shingles(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """The most frequent shingles of the zone, HOT at most. Those that a batch holds once are not told for it: what is frequent
    stands several times in many batches, and the list only decides what is cheap."""
    limit = _zone(percent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, kept = texts_of(batch), [np.zeros(0, _U)]
            for a, b in portions(raws, BYTES_AT_ONCE):
                grams = Sets(raws[a:b], words).grams
                kept.append(grams[grams < limit])
            token, n = np.unique(np.concatenate(kept), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= HOT_TEXTS).orderBy(F.col("n").desc(), "token").limit(HOT).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(dtype=np.int64).view(_U))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(v) for v in values])
    whole = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole.view(np.int64)))


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, key (hash of id and text), rid (identity of the set), n, bits, least, prefix: one row for each row of docs. Where
    a batch has a set twice, the last three stand in one row."""
    shared = docs.sparkSession.sparkContext.broadcast(_hot_shingles(docs, words, percent))

    def frequent(grams: np.ndarray) -> np.ndarray:
        hot = shared.value
        out = np.zeros(len(grams), dtype=bool)
        low = np.flatnonzero(grams < _zone(percent)) if len(hot) else []
        if len(low):
            at = np.minimum(np.searchsorted(hot, grams[low]), len(hot) - 1)
            out[low] = hot[at] == grams[low]
        return out

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            raws, seen = texts_of(batch), set()
            for begin, end in portions(raws, BYTES_AT_ONCE):
                sets = Sets(raws[begin:end], words)
                rid, bits, least, last = sets.digests(), sets.bitmaps(), sets.least(), frequent(sets.grams)
                mins, prefix = [], []
                for k, (a, b) in enumerate(zip(sets.at[:-1].tolist(), sets.at[1:].tolist())):
                    if b == a or int(rid[k]) in seen:
                        bits[k] = b""
                        mins.append(none)
                        prefix.append(none)
                        continue
                    seen.add(int(rid[k]))
                    s, late, p = sets.grams[a:b], last[a:b], prefix_length(b - a, percent)
                    mins.append(least[k])
                    prefix.append((np.concatenate((s[~late][:p], s[late]))[:p] if late.any() else s[:p]).view(np.int64))
                own = [batch.column(c).slice(begin, end - begin) for c in ("doc_id", "key")]
                made = [pa.array(rid), pa.array(sets.size), pa.array(bits, pa.binary()), _lists(mins), _lists(prefix)]
                yield pa.RecordBatch.from_arrays([*own, *made], ["doc_id", "key", "rid", "n", "bits", "least", "prefix"])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    shape = f"doc_id {type_of(docs, 'doc_id')}, key long, rid long, n long, bits binary, least array<long>, prefix array<long>"
    return durable(rows.mapInArrow(sign, shape))


def _arrays(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """rid, grams of the sets of the rows needed(key), and of a few more: rows outside a filter of fixed size over the keys
    are passed over without being hashed."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(needed))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(shared.value, batch.column("key").to_numpy())
            raws = texts_of(batch.filter(pa.array(hit)))
            for a, b in portions(raws, BYTES_AT_ONCE):
                sets = Sets(raws[a:b], words)
                yield pa.RecordBatch.from_arrays([pa.array(sets.digests()), _lists([sets[k] for k in range(len(sets.size))])], ["rid", "grams"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    return rows.mapInArrow(collect, "rid long, grams array<long>").dropDuplicates(["rid"])


def _weight() -> Column:
    return F.greatest(F.col("n") / LONG, F.lit(1.0))


def _meeting(heads: DataFrame, turn: int) -> tuple[DataFrame, bool]:
    """Tiles of heads(rid, n, bits, least) with the same least hash, and whether a group was cut."""
    met = heads.select(F.get("least", F.lit(turn)).alias("key"), "rid", "n", "bits")
    groups = durable(met.groupBy("key").agg(F.sum(_weight()).alias("weight"), F.count("*").alias("heads")).where("heads > 1").drop("heads"))
    cut = not groups.where(F.col("weight") > TILE).isEmpty()
    part = F.pmod(F.xxhash64("rid", F.lit(turn)), F.ceil(F.col("weight") / TILE).cast("int"))
    key = F.when(F.col("weight") > TILE, F.xxhash64("key", part)).otherwise(F.col("key"))
    side = F.lit(0).cast("long").alias("side")
    return met.join(groups, "key").select(key.alias("key"), side, "rid", F.col("rid").alias("comp"), "n", "bits"), cut


def _routes(signed: DataFrame) -> DataFrame:
    """token, rid: shingles in the prefix of several sets, one for each different membership. Batches may state a set again, so rows are
    made different first; then the exclusive or of a shingle's rows, with their number, tells its members."""
    rows = signed.select("rid", F.explode("prefix").alias("token")).where("token is not null and rid is not null").repartition("token").distinct()
    look = F.bit_xor(F.xxhash64("rid"))
    tokens = rows.groupBy("token").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), look.alias("look"), F.count("*").alias("rows")).where("lo <> hi")
    kept = tokens.groupBy("look", "lo", "hi", "rows").agg(F.min("token").alias("token")).select("token")
    return rows.join(kept, "token").select("token", "rid")


def _routed_tiles(routes: DataFrame, labels: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """key, side, rid, comp, n, bits: tiles of the shingles routes(token, rid) that sets of several classes of labels(rid, comp, n)
    share. Pairs of a tile with two sides are those across the sides."""
    rows = durable(routes.join(labels, "rid"))
    tokens = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(_weight()).alias("weight")).where("lo <> hi")
    alive = durable(rows.join(tokens.select("token", "weight"), "token"))
    discard(rows)
    tiles = alive.where(F.col("weight") <= TILE).select(F.col("token").alias("key"), F.lit(0).cast("long").alias("side"), "rid", "comp", "n")
    large = alive.where(F.col("weight") > TILE)
    if not large.isEmpty():
        tiles = tiles.union(_parts(large, percent))
    return tiles.join(reps.select("rid", "bits"), "rid").select("key", "side", "rid", "comp", "n", "bits")


def _parts(large: DataFrame, percent: int) -> DataFrame:
    """Tiles of pairs of parts, for the shingles large(token, rid, comp, n) with too many members. Classes with the weight of half a
    tile have parts of their own; the others, loose ones, share parts."""
    half, group = TILE / 2, ["token", "band"]
    step = float(-np.log((percent - 0.5) / 100))  # a little wide, so that rounding parts no pair
    band = F.floor(F.log("n") / step).cast("long")
    rows = durable(large.select("token", "rid", "comp", "n", F.explode(F.array(band, band + 1)).alias("band")))
    own = rows.groupBy(*group, "comp").agg(F.sum(_weight()).alias("own"))
    loose = F.col("own") < half
    classes = durable(own.select(*group, "comp", loose.alias("loose"), F.ceil(F.col("own") / half).cast("int").alias("parts"), "own"))
    rest = classes.where("loose").groupBy(*group).agg(F.ceil(F.sum("own") / half).cast("int").alias("loose_parts"))
    side = F.xxhash64(*group, "loose", F.when(~F.col("loose"), F.col("comp")), "part").alias("side")
    part = F.when(F.col("loose"), F.pmod(F.xxhash64("comp"), F.coalesce("loose_parts", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rid"), F.col("parts")))
    placed = rows.join(classes.drop("own"), [*group, "comp"]).join(rest, group, "left").withColumn("part", part)
    placed = placed.select("rid", "comp", "n", side)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("part")
    tight = classes.where("not loose").select(*group, "loose", "comp", every("parts"))
    slack = rest.select(*group, F.lit(True).alias("loose"), F.lit(None).cast("long").alias("comp"), every("loose_parts"))
    sides = durable(tight.union(slack).withColumn("part", F.col("part").cast("long")).select(*group, "loose", "comp", side))
    a, b = (sides.select(*group, *(F.col(c).alias(f"{c}_{x}") for c in ("loose", "comp", "side"))) for x in "ab")
    apart = F.col("loose_a") | F.col("loose_b") | (F.col("comp_a") != F.col("comp_b"))
    meets = a.join(b, group).where((F.col("side_a") <= F.col("side_b")) & apart)
    ends = meets.select(F.xxhash64("side_a", "side_b").alias("key"), F.explode(F.array_distinct(F.array("side_a", "side_b"))).alias("side"))
    return placed.join(ends, "side").select("key", "side", "rid", "comp", "n")


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables of whole tiles: of one, or of several with TILE rows at most."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        key = rows.column("key").to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin = 0
        while begin < (ends[-1] if len(ends) else 0):
            end = int(ends[max(np.searchsorted(ends, begin + TILE, side="right") - 1, np.searchsorted(ends, begin, side="right"))])
            yield rows.slice(begin, end - begin)
            begin = end
        rest = rows.slice(begin)
    if rest is not None:
        yield rest


class Tiles:
    """Whole tiles as arrays: rows sorted by key and size, a set once a tile and side."""

    def __init__(self, rows: pa.Table, percent: int):
        key, side, rid, self.comp, self.n = (rows.column(c).to_numpy() for c in ("key", "side", "rid", "comp", "n"))
        self.percent, self.rid = percent, rid
        self.bits = Bitmaps(rows.column("bits").to_pylist())
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.tile = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        two = np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first)
        self.two, self.side = two[self.tile], side
        # rows of a tile ascend in size: where those end that are not too large for a row
        order = self.tile * (1 << 32) + self.n
        self.stop = np.searchsorted(order, self.tile * (1 << 32) + 100 * self.n // percent, side="right")

    def passing(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of rows that may be similar enough and are not in one class yet, and in how many bits they differ."""
        at = np.arange(len(self.n))
        many = np.maximum(0, self.stop - at - 1)
        total = np.concatenate(([0], np.cumsum(many)))
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS_AT_ONCE, side="right")) - 1)
            i = np.repeat(at[begin:end], many[begin:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], many[begin:end])
            keep = (self.comp[i] != self.comp[j]) & (~self.two[i] | (self.side[i] != self.side[j]))
            i, j = i[keep], j[keep]
            differ, size = self.bits.differ(i, j), self.n[i] + self.n[j]
            ok = (100 + self.percent) * (size - differ) >= 2 * self.percent * size
            yield i[ok], j[ok], differ[ok]
            begin = end


def _compare(percent: int):  # noqa: ANN202
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a partner whose bitmap passes; `both` tells those of tiles with two sides."""
        for rows in _whole_tiles(batches):
            hit, tiles = np.zeros(rows.num_rows, dtype=bool), Tiles(rows, percent)
            for i, j, _ in tiles.passing():
                hit[i] = hit[j] = True
            if hit.any():
                yield from rows.append_column("both", pa.array(tiles.two)).filter(pa.array(hit)).combine_chunks().to_batches()

    return compare


def _once(percent: int):  # noqa: ANN202
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that passed, with the keys of all one-sided tiles in which they did (others), those with a partner that they meet in
        no tile with a smaller key. Pairs in tiles with two sides always count."""
        for rows in _whole_tiles(batches):
            key, both, held = rows.column("key").to_pylist(), rows.column("both").to_pylist(), rows.column("others").to_pylist()
            others = [set(x or ()) for x in held]
            hit = np.zeros(rows.num_rows, dtype=bool)
            for i, j, _ in Tiles(rows, percent).passing():
                for x, y in zip(i.tolist(), j.tolist()):
                    if not (hit[x] and hit[y]) and (both[x] or min(others[x] & others[y]) == key[x]):
                        hit[x] = hit[y] = True
            if hit.any():
                yield from rows.drop_columns(["others"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return once


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _join_classes(tiles: Tiles, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Classes that verified links make one, tile by tile, each with the one of them that has most links."""
    pairs = [np.concatenate(x) for x in zip(*tiles.passing())] or [np.zeros(0, np.int64)] * 3
    own, of = np.unique(np.stack((tiles.tile, tiles.comp)), axis=1, return_inverse=True)
    of = of.reshape(-1)
    parent, links = np.arange(own.shape[1]), np.zeros(own.shape[1], dtype=np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    i, j, differ = pairs
    order = np.lexsort((differ, tiles.tile[i]))
    i, j = i[order], j[order]
    while len(i):
        top = parent.copy()
        while (top != top[top]).any():
            top = top[top]
        apart = top[of[i]] != top[of[j]]
        i, j = i[apart], j[apart]
        for x, y in zip(i[:VERIFIED_AT_ONCE].tolist(), j[:VERIFIED_AT_ONCE].tolist()):
            a, b = root(int(of[x])), root(int(of[y]))
            if a != b and _similar(sets[x], sets[y], tiles.percent):
                parent[a] = b
                links[of[x]] += 1
                links[of[y]] += 1
        i, j = i[VERIFIED_AT_ONCE:], j[VERIFIED_AT_ONCE:]
    top = np.array([root(x) for x in range(len(parent))], dtype=np.int64)
    hub = np.lexsort((np.arange(len(top)), -links, top))
    first = hub[np.concatenate(([True], top[hub][1:] != top[hub][:-1]))] if len(hub) else hub
    best = np.zeros(len(top), dtype=np.int64)
    best[top[first]] = first
    to = best[top]
    moved = np.flatnonzero(to != np.arange(len(top)))
    return own[1][moved], own[1][to[moved]]


def _verify(percent: int):  # noqa: ANN202
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tiles(batches):
            grams = rows.column("grams").combine_chunks()
            values, at = grams.values.to_numpy().view(_U), grams.offsets.to_numpy()
            a, b = _join_classes(Tiles(rows, percent), [values[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return verify


PASSED = "key long, side long, rid long, comp long, n long, bits binary, both boolean"


def _merges(docs: DataFrame, tiles: DataFrame, reps: DataFrame, words: int, percent: int, apart: bool) -> DataFrame:
    """a, b: classes of tiles(key, side, rid, comp, n, bits) that verified links make one, each with that of most links in the tile. Where
    tiles are not apart, a pair that shares several is verified in one of them."""
    dealt = lambda rows: rows.repartition("key").sortWithinPartitions("key", "n", "rid")
    passed = durable(dealt(tiles).mapInArrow(_compare(percent), PASSED))
    if not apart:
        first = passed
        others = first.where("not both").groupBy("rid").agg(F.collect_list("key").alias("others"))  # a prefix at most
        marked = first.join(others, "rid", "left").select(*first.columns, "others")
        passed = durable(dealt(marked).mapInArrow(_once(percent), PASSED))
        discard(first)
    needed = reps.join(passed.select("rid").distinct(), "rid", "left_semi").select("key")
    full = passed.join(_arrays(docs, needed, words), "rid")
    merged = durable(dealt(full).mapInArrow(_verify(percent), "a long, b long").distinct())
    discard(passed)
    return merged


def _relabelled(labels: DataFrame, to: DataFrame) -> DataFrame:
    """labels(rid, comp, n) with classes replaced by to(id, component)."""
    new = labels.join(to, F.col("comp") == F.col("id"), "left").select("rid", F.coalesce("component", "comp").alias("comp"), "n")
    new = durable(new)
    discard(labels)
    return new


def _classes(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, key (hash of id and text), n, rid, one for each row of docs; and classes of their sets: rid, comp (the class's own name)."""
    signed = _signed(docs, words, percent)
    full = signed.where("n > 0")
    reps = durable(full.groupBy("rid").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("least").alias("least")))
    labels, heads = durable(reps.select("rid", F.col("rid").alias("comp"), "n")), reps
    for turn in range(MEETINGS):
        tiles, cut = _meeting(heads, turn)
        merged = _merges(docs, tiles, reps, words, percent, apart=True)
        labels = _relabelled(labels, merged.select(F.col("a").alias("id"), F.col("b").alias("component")))
        heads = reps.join(labels.select("comp").distinct(), F.col("rid") == F.col("comp"), "left_semi")
        if not cut:
            break
    tiles = _routed_tiles(_routes(full), labels, reps, percent)
    merged = _merges(docs, tiles, reps, words, percent, apart=False)
    return signed.select("doc_id", "key", "n", "rid"), _relabelled(labels, components(merged)).select("rid", "comp")


def similar_classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, rid (the set), component_id (smallest id of the class), one row for each row of docs(doc_id, text)."""
    rows, classes = _classes(docs, percent, words)
    own = rows.where("n > 0").groupBy("rid").agg(F.min("doc_id").alias("doc_id")).join(classes, "rid")
    least = own.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(least, "comp").select("rid", "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "rid", F.col("doc_id").alias("component_id"))
    linked = rows.where("n > 0").join(named, "rid")  # a set with very many copies is split by the adaptive planner
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "rid", "component_id").union(alone)


def keep_first(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The rows of docs that are the first of their class, one for each class, and those without words, with all their columns.
    First is the smallest id, and of its texts the one with the smallest hash; of equal rows one stays. Rows are told apart by id
    and text, as an id may stand with several texts."""
    rows, classes = _classes(docs, percent, words)
    rows = rows.where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = rows.groupBy("rid").agg(F.min(order).alias("first")).join(classes, "rid").groupBy("comp").agg(F.min("first").alias("first"))
    first = durable(first.select(F.col("first.key").alias("key")))
    key = unused("key", docs.columns)
    later = sided(rows.select("key").distinct().join(first, "key", "left_anti").withColumnRenamed("key", key))
    kept = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(later, key, "left_anti")
    twice = rows.join(first, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias(key))
    twice = durable(twice)
    if twice.isEmpty():
        return kept.select(docs.columns)
    again = sided(twice)
    once = kept.join(again, key, "left_semi").dropDuplicates([key])
    return kept.join(again, key, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Every linked pair by a join on shingles, then reachability. Lower-casing is of A-Z alone.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3
      UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

"""Exact top-k retrieval by score bounds, over an index that is kept up.

Contents. Chunks with equal contents score alike, so an index holds each content once, by its md5. Weights are those of retrieval.py:
tf * idf, divided by the content's norm. As a token's weights in query and content carry the same sign of idf, every product adds to the score, and absolute
values are kept.

Blocks. Contents are dealt out by their hashes, sorted by their number of tokens within a task and cut into blocks of SIZE. A content's tokens stay together
as one row's array; the weights of frequent tokens are broadcast, only rows of others are joined. A block's row holds, for each of its tokens, the postings (place in
the block, weight) and the largest weight; and for each content the norm of what it has of tokens at least as common as each of STAGES.

Search. The queries' tokens are broadcast, at most AT_ONCE of them at a time, and blocks pass by once. The largest weights bound what a block can give a query; a query that
can't reach its k-th best score so far passes the block over. Otherwise its tokens are taken from rare to common, and a content is
dropped as soon as its sum so far, with the smaller of two bounds of the rest (largest weights of the tokens left; Cauchy-Schwarz with the content's
norm at that stage), is below. A join of rare tokens alone gives every query k lower bounds to start from; a few blocks go first and
raise them. Scores that pass are complete sums: nothing is approximate, and k rows a query and task meet in the last ranking.

Defined results: null content has no tokens; contents or queries without a weighed token match nothing; equal scores (at six decimals) go to the larger
chunk_id; a chunk_id that stands twice counts twice; an empty table or index gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.operators import retrieval
from codequarry.session import discard, durable, written
from codequarry.sources.versions import Versions

#: Contents of a block; tokens of queries that are broadcast at once; a token of at most one in RARE chunks is rare.
SIZE, AT_ONCE, RARE = 16, 1_000_000, 500
#: Shares of the chunks at which the norm of a content's more common tokens is kept.
STAGES = (0.0, 0.01, 0.03, 0.06, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.7)
#: Blocks of the rounds of a search, in so many parts of the last number.
ROUNDS = (1, 4, 16, 32, 64)
#: Blocks that a task orders by their bounds at once.
GROUP = 128
#: Scores are compared at six decimals; bounds are wider by this.
MARGIN = 1e-6
#: A content's tokens as a version stores them.
TERMS = "hash string, terms array<struct<token:string,tf:bigint>>"


def contents_of(chunks: DataFrame) -> DataFrame:
    """chunk_id, content, hash: what an index tells contents by."""
    return chunks.select("chunk_id", "content", F.md5(F.coalesce("content", F.lit(""))).alias("hash"))


def _weights(terms: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """query, token, w and share for terms(query, token, tf): weights over the query's norm, and the share of the n chunks that have the token."""
    known = durable(retrieval.inverse_frequencies(frequency, n)).withColumn("share", F.col("df") / n)
    both = durable(retrieval.weighted(terms, known))
    norms = both.groupBy("query").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return both.join(norms, "query").select("query", "token", F.abs(F.col("w") / F.col("norm")).alias("w"), "share")


def _block(hashes: pa.Array, lasts: pa.Array, sizes: np.ndarray, tokens: pa.Array, w: np.ndarray, share: np.ndarray) -> dict:
    """One block's row from its contents, with so many tokens each."""
    place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    stage = np.searchsorted(STAGES, share, side="left") - 1
    squares = np.bincount(place * len(STAGES) + stage, weights=w * w, minlength=len(sizes) * len(STAGES)).reshape(len(sizes), -1)
    words = tokens.dictionary_encode()
    number = words.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    number, w = number[order], w[order]
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return {
        "hashes": hashes.to_pylist(), "lasts": lasts.to_pylist(), "tokens": words.dictionary.to_pylist(), "starts": [*starts.tolist(), len(number)], "places": place[order],
        "weights": w, "most": np.maximum.reduceat(w, starts), "tails": np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]).ravel(),
    }


def _blocks(part: pa.RecordBatch, words: pa.Array, idf: np.ndarray, share: np.ndarray) -> Iterator[dict]:
    """Blocks of some contents: hash, last, terms(token, tf) whose weights are looked up, rest(token, w, share) of tokens that are not in words."""
    terms, rest = (part.column(c) for c in ("terms", "rest"))
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (terms, rest)]
    place = [np.repeat(np.arange(part.num_rows), n) for n in sizes]
    terms, rest = terms.flatten(), rest.flatten()
    at = pc.fill_null(pc.index_in(terms.field("token"), value_set=words), -1).to_numpy(zero_copy_only=False)
    here = np.flatnonzero(at >= 0)
    at = at[here]
    place = np.concatenate((place[0][here], place[1]))
    order = np.argsort(place, kind="stable")
    tokens = pa.concat_arrays([terms.field("token").take(pa.array(here)), rest.field("token")]).take(pa.array(order))
    w = np.concatenate((terms.field("tf").to_numpy(zero_copy_only=False)[here] * idf[at], rest.field("w").to_numpy(zero_copy_only=False)))
    norm = np.sqrt(np.bincount(place, weights=w * w, minlength=part.num_rows))
    w, share = np.abs(w / norm[place])[order], np.concatenate((share[at], rest.field("share").to_numpy(zero_copy_only=False)))[order]
    size = np.bincount(place, minlength=part.num_rows)
    starts, filled = np.concatenate(([0], np.cumsum(size))), np.flatnonzero(size)
    for k in range(0, len(filled), SIZE):
        own = filled[k : k + SIZE]
        s, e = starts[own[0]], starts[own[-1] + 1]
        yield _block(part.column("hash").take(pa.array(own)), part.column("last").take(pa.array(own)), size[own], tokens.slice(s, e - s), w[s:e], share[s:e])


def blocks_of(contents: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """The index: blocks of contents(hash, last, terms), whose last is the largest chunk_id of each, by frequency(token, df) of n chunks."""
    common, rare = retrieval.common_and_rare(durable(retrieval.inverse_frequencies(frequency, n)))
    rest = F.lit(None).cast("array<struct<token:string,w:double,share:double>>")
    if rare is None:
        contents = contents.withColumn("rest", rest)
    else:
        left = contents.select("hash", F.inline("terms")).join(F.broadcast(common.select("token")), "token", "left_anti").join(rare, "token")
        left = left.select("hash", F.struct("token", (F.col("tf") * F.col("idf")).alias("w"), (F.col("df") / n).alias("share")).alias("x"))
        contents = contents.join(left.groupBy("hash").agg(F.collect_list("x").alias("rest")), "hash", "left")
    known = common.select("token", "idf", (F.col("df") / n).alias("share")).toPandas()  # about retrieval.BROADCAST rows
    shared = contents.sparkSession.sparkContext.broadcast((known["token"].tolist(), known["idf"].to_numpy(dtype=float), known["share"].to_numpy(dtype=float)))
    names = ["block", "hashes", "lasts", "tokens", "starts", "places", "weights", "most", "tails"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value[0], pa.string())
        for batch in batches:
            types = [pa.int32(), pa.list_(pa.string()), pa.list_(batch.schema.field("last").type), pa.list_(pa.string()), *(pa.list_(t) for t in (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))]
            for k in range(0, batch.num_rows, SIZE * GROUP):
                for row in _blocks(batch.slice(k, SIZE * GROUP), words, *shared.value[1:]):
                    spread = zlib.crc32(row["hashes"][0].encode()) & 0x7FFFFFFF
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((spread, *row.values()), types, strict=True)], names)

    kind = contents.schema["last"].dataType.simpleString()
    shape = f"block int, hashes array<string>, lasts array<{kind}>, tokens array<string>, starts array<int>, places array<int>, weights array<double>, most array<double>, tails array<double>"
    sized = contents.withColumn("size", F.size("terms")).sortWithinPartitions("size", "hash")
    return sized.select("hash", "last", "terms", "rest").mapInArrow(cut, shape)


class _Asked:
    """Queries' tokens as flat arrays, those of a query from rare to common, and lower bounds of their k-th best scores."""

    def __init__(self, pdf: pd.DataFrame, floor: dict):
        pdf = pdf.sort_values(["query", "share", "token"], kind="stable")
        self.vocabulary = pa.array(sorted(set(pdf["token"])), pa.string())
        number = {t: i for i, t in enumerate(self.vocabulary.to_pylist())}
        self.token, self.weight = np.array([number[t] for t in pdf["token"]], dtype=np.int64), pdf["w"].to_numpy()
        self.stage = np.searchsorted(STAGES, pdf["share"].to_numpy(), side="left") - 1
        self.query, self.start = np.unique(pdf["query"].to_numpy(), return_index=True)
        self.end = np.append(self.start[1:], len(pdf))
        self.floor = np.array([floor.get(q, 0.0) for q in self.query.tolist()])


class _Best:
    """The k best of each query so far, and the score below which nothing is looked at."""

    def __init__(self, asked: _Asked, k: int):
        self.asked, self.k, self.floor, self.found, self.products = asked, k, asked.floor.copy(), {}, 0

    def add(self, q: int, score: float, last, content: str) -> None:  # noqa: ANN001
        best = self.found.setdefault(q, [])
        bisect.insort(best, (score, last is not None, last, content) if last is not None else (score, False, content, content))
        if len(best) > self.k:
            best.pop(0)
        if len(best) == self.k:
            self.floor[q] = max(self.floor[q], best[0][0])

    def scan(self, rows: list[dict]) -> None:
        """Score some blocks, for each query from the most promising one on, until none can reach its floor."""
        asked, buffer = self.asked, np.zeros(len(self.asked.vocabulary))
        bounds, known = np.zeros((len(rows), len(asked.query))), []
        for i, row in enumerate(rows):
            at = pc.index_in(row["tokens"], value_set=asked.vocabulary)
            here = np.flatnonzero(~at.is_null().to_numpy(zero_copy_only=False))
            number = at.take(pa.array(here)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(number)
            known.append((number[order], here[order]))
            buffer[number] = row["most"][here]
            bounds[i] = np.add.reduceat(asked.weight * buffer[asked.token], asked.start)
            buffer[number] = 0
        for q in np.flatnonzero((bounds >= self.floor - MARGIN).any(axis=0) & (bounds > 0).any(axis=0)).tolist():
            for i in np.argsort(-bounds[:, q], kind="stable").tolist():
                if bounds[i, q] < self.floor[q] - MARGIN or bounds[i, q] <= 0:
                    break
                self._score(q, rows[i], *known[i])

    def _score(self, q: int, row: dict, number: np.ndarray, here: np.ndarray) -> None:
        """Score the contents of a block for a query, token by token from rare to common."""
        asked, floor = self.asked, self.floor[q] - MARGIN
        own = np.arange(asked.start[q], asked.end[q])
        place = np.minimum(np.searchsorted(number, asked.token[own]), len(number) - 1)
        own, place = own[same := number[place] == asked.token[own]], place[same]
        token, weight, stage = here[place], asked.weight[own], asked.stage[own]
        left = np.cumsum((weight * row["most"][token])[::-1])[::-1]
        size = np.sqrt(np.cumsum((weight * weight)[::-1])[::-1])
        tails = row["tails"].reshape(-1, len(STAGES))
        total, alive = np.zeros(len(tails)), np.ones(len(tails), dtype=bool)
        for i, t in enumerate(token.tolist()):
            alive &= total + np.minimum(left[i], size[i] * tails[:, stage[i]]) >= floor
            if not alive.any():
                return
            s, e = row["starts"][t], row["starts"][t + 1]
            at = row["places"][s:e]
            keep = alive[at]
            total[at[keep]] += weight[i] * row["weights"][s:e][keep]
            self.products += int(keep.sum())
        for p in np.flatnonzero(alive & (total > 0) & (total >= floor)).tolist():
            if (score := round(float(total[p]), 6)) > 0:
                self.add(q, score, row["lasts"][p].as_py(), row["hashes"][p].as_py())


def _row(batch: pa.RecordBatch, i: int) -> dict:
    """Lists of a block's row: those of numbers as numpy arrays."""
    out = {c: batch.column(c)[i].values for c in ("hashes", "lasts", "tokens")}
    return out | {c: batch.column(c)[i].values.to_numpy() for c in ("starts", "places", "weights", "most", "tails")}


def _scan(blocks: DataFrame, asked: _Asked, k: int) -> DataFrame:
    """query, hash, last, score: the k best contents of each query and task; beside them, a row with the products made, which has no query."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)
    last = blocks.schema["lasts"].dataType.elementType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(shared.value, k)
        kind = None
        for batch in batches:
            kind = batch.schema.field("lasts").type.value_type
            for begin in range(0, batch.num_rows, GROUP):
                best.scan([_row(batch, i) for i in range(begin, min(begin + GROUP, batch.num_rows))])
        if kind is not None:
            rows = [(int(best.asked.query[q]), h, x if known else None, s) for q, found in best.found.items() for s, known, x, h in found]
            columns = list(zip(*rows, (None, None, None, float(best.products)), strict=True))
            kinds = (pa.int64(), pa.string(), kind, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "hash", "last", "score"])

    return blocks.mapInArrow(scan, f"query long, hash string, last {last.simpleString()}, score double")


def _postings(blocks: DataFrame, tokens: list[str]) -> DataFrame:
    """token, hash, w: what blocks hold of some tokens."""
    shared = blocks.sparkSession.sparkContext.broadcast(tokens)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.string())
        for batch in batches:
            for begin in range(0, batch.num_rows, GROUP):
                part = batch.slice(begin, GROUP)
                here = pc.is_in(part.column("tokens").flatten(), value_set=wanted).to_numpy(zero_copy_only=False)
                ends = np.cumsum(pc.list_value_length(part.column("tokens")).to_numpy(zero_copy_only=False))
                found = [], [], []
                for i, own in enumerate(np.split(here, ends[:-1])):
                    row = _row(part, i)
                    for t in np.flatnonzero(own).tolist():
                        s, e = row["starts"][t], row["starts"][t + 1]
                        for x, new in zip(found, ([row["tokens"][t].as_py()] * (e - s), [row["hashes"][p].as_py() for p in row["places"][s:e].tolist()], row["weights"][s:e].tolist()), strict=True):
                            x.extend(new)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.string(), pa.float64()), strict=True)], ["token", "hash", "w"])

    return blocks.mapInArrow(pick, "token string, hash string, w double")


class Index:
    """Blocks and frequencies of n chunks; chunk ids by content."""

    def __init__(self, blocks: DataFrame, frequency: DataFrame, n: int, chunks: DataFrame):
        self.blocks, self.frequency, self.n, self.chunks = blocks, frequency, n, chunks

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query, token, w, share for queries(query, content)."""
        terms = durable(retrieval.term_frequencies(queries.select(F.col("query").alias("chunk_id"), "content")).withColumnRenamed("chunk_id", "query"))
        known = self.frequency.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi") if terms.count() <= AT_ONCE else self.frequency
        return durable(_weights(terms, known, self.n))

    def _rare_products(self, asked: DataFrame) -> DataFrame:
        """query, hash, product: a row for each rare token that a query and a content share; asked has AT_ONCE rows or about."""
        rare = asked.where(F.col("share") * RARE <= 1).select("query", "token", F.col("w").alias("qw"))
        words = [r.token for r in rare.select("token").distinct().collect()]
        return _postings(self.blocks, words).join(rare, "token").select("query", "hash", (F.col("w") * F.col("qw")).alias("product"))

    def _parts(self, asked: DataFrame) -> list[DataFrame]:
        """asked by its queries, in parts of AT_ONCE rows or about."""
        parts = -(-asked.count() // AT_ONCE)
        return [asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part) for part in range(parts)]

    @staticmethod
    def _kth(scores: DataFrame, k: int) -> dict:
        """The k-th best score of each query of scores(query, hash, score) that has k."""
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        best = scores.withColumn("rank", rank).where(F.col("rank") == k).select("query", "score")
        return {r.query: r.score for r in best.collect()}

    def _found(self, queries: DataFrame, k: int) -> DataFrame:
        """Best contents and counts of products, as _scan tells them, for queries(query, content). Blocks are scanned in ROUNDS, each of which starts from the
        k-th best scores of those before."""
        out = self.blocks.sparkSession.createDataFrame([], f"query long, hash string, last {self.blocks.schema['lasts'].dataType.elementType.simpleString()}, score double")
        for here in self._parts(self._asked(queries)):
            some = here.select("query", "token", "w", "share").toPandas()  # AT_ONCE rows or about
            if not len(some):
                continue
            floor = self._kth(self._rare_products(here).groupBy("query", "hash").agg(F.sum("product").alias("score")), k)
            found, begin = None, 0
            for end in ROUNDS:
                blocks = self.blocks.where((F.col("block") % ROUNDS[-1] >= begin) & (F.col("block") % ROUNDS[-1] < end))
                more = durable(_scan(blocks, _Asked(some, floor), k))
                found, begin = more if found is None else found.unionByName(more), end
                if end < ROUNDS[-1]:
                    floor |= {q: x for q, x in self._kth(found.where("query is not null"), k).items() if x > floor.get(q, 0)}
            out = out.unionByName(found)
        return out

    def search(self, queries: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
        """query_id, rank, chunk_id, score for queries(query_id, content)."""
        named = durable(queries.select("query_id", "content").withColumn("query", F.monotonically_increasing_id()))
        found = self._found(named, k).where("query is not null")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("last").desc())
        contents = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place", "last")
        # of a content's copies, the k largest ids; a window keeps k rows of each before rows meet
        own = Window.partitionBy("hash").orderBy(F.col("chunk_id").desc())
        wanted = self.chunks.join(F.broadcast(contents.select("hash").distinct()), "hash", "left_semi") if contents.count() <= AT_ONCE else self.chunks.join(contents.select("hash").distinct(), "hash", "left_semi")
        copies = wanted.withColumn("copy", F.row_number().over(own)).where(F.col("copy") <= k).drop("copy")
        ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("chunk_id").desc())
        hits = contents.join(copies, "hash").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        return hits.join(named.select("query", "query_id"), "query").select("query_id", "rank", "chunk_id", "score")

    def products(self, queries: DataFrame, k: int = retrieval.TOP_K) -> tuple[int, int]:
        """Products of weights that a search makes, and that scoring every chunk with a token of the query would make."""
        named = durable(queries.select("query_id", "content").withColumn("query", F.monotonically_increasing_id()))
        made = self._found(named, k).where("query is null").agg(F.sum("score")).first()[0] or 0
        asked = self._asked(named)
        rare = sum(self._rare_products(here).count() for here in self._parts(asked))
        every = asked.select("token").join(self.frequency, "token").agg(F.sum("df")).first()[0] or 0
        return int(made) + rare, int(every)


def index_of(chunks: DataFrame) -> Index:
    """An index of chunks(chunk_id, content) for this session. Rows are texts' tokens; copies go as they are gathered by hash, those of a task first."""
    rows = written(retrieval.term_arrays(contents_of(chunks)))
    frequency = durable(retrieval.frequencies(rows).select("token", "df"))
    own = rows.select("chunk_id", "hash")
    n = own.count()
    contents = rows.groupBy("hash").agg(F.max("chunk_id").alias("last"), F.first("terms").alias("terms"))
    return Index(written(blocks_of(contents, frequency, n)), frequency, n, own)


def top_chunks(chunks: DataFrame, queries: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
    """query_id, rank, chunk_id, score for queries(query_id, content): the k best chunks with a positive score."""
    return index_of(chunks).search(queries, k)


class KeptIndex:
    """An index in a folder, kept up by differences.

    Each version holds live(chunk_id, hash), frequency(token, df), and the terms of the contents that it is the first to hold, a row a content. An update compares ids and hashes
    with the live ones, cuts only contents into words that no version holds, and moves frequencies by the words of contents that came or went, so removed
    chunks cost a look at their stored terms. merge() writes the terms of live contents as one segment and drops older versions. Blocks are made at
    the first search of a version and stay with it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def _known(self, name: str, schema: str) -> DataFrame:
        """A table over all versions since the last merge."""
        out = self.spark.createDataFrame([], schema)
        for n in self.versions.numbers():
            out = out.unionByName(self.versions.read(n, name))
        return out

    def _last(self, name: str, schema: str) -> DataFrame:
        n = self.versions.latest()
        return self.versions.read(n, name) if n else self.spark.createDataFrame([], schema)

    def update(self, chunks: DataFrame) -> dict[str, int]:
        """Make the index one of chunks(chunk_id, content), whose ids are different; tells chunks added, changed and removed, and contents cut into words."""
        now = written(contents_of(chunks).withColumn("row", F.monotonically_increasing_id()))
        kind = now.schema["chunk_id"].dataType.simpleString()
        live = self._last("live", f"chunk_id {kind}, hash string")
        pair = now.select("row", F.col("chunk_id").alias("id"), F.col("hash").alias("new")).join(live.select(F.col("chunk_id").alias("old_id"), F.col("hash").alias("old")), F.col("id") == F.col("old_id"), "full")
        moved = durable(pair.where("not (new <=> old)").select("row", "new", "old"))
        came = moved.where("new is not null").select(F.col("new").alias("hash"), F.lit(1).alias("n"), "row")
        gone = moved.where("old is not null").select(F.col("old").alias("hash"), F.lit(-1).alias("n"), F.lit(None).cast("long").alias("row"))
        net = durable(came.union(gone).groupBy("hash").agg(F.sum("n").alias("n"), F.max("n").alias("sign"), F.max("row").alias("row")))
        fresh = durable(net.where("sign > 0").join(self._known("contents", "hash string"), "hash", "left_anti").select("row", "n"))
        n_cut = fresh.count()
        # one row of each fresh content is cut; contents that were there move frequencies by their stored terms
        cut = now.join(F.broadcast(fresh) if n_cut <= retrieval.BROADCAST else fresh, "row").select("hash", "n", "content")
        terms = written(retrieval.term_arrays(cut))
        stored = self._known("terms", TERMS).join(net.where("n <> 0").select("hash", "n"), "hash").unionByName(terms)
        delta = stored.select("n", F.inline("terms")).groupBy("token").agg(F.sum("n").alias("df"))
        frequency = self._last("frequency", "token string, df long").unionByName(delta).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        counts = moved.agg(*(F.count_if(F.expr(x)).alias(k) for k, x in (("added", "old is null"), ("changed", "old is not null and new is not null"), ("removed", "new is null")))).first()
        self.versions.write(live=now.select("chunk_id", "hash"), frequency=frequency, contents=terms.select("hash"), terms=terms.select("hash", "terms"))
        discard(now, terms)
        return {**counts.asDict(), "contents_cut": n_cut}

    def merge(self) -> None:
        """One segment of the live contents' terms."""
        if not self.versions.latest():
            return
        live = self._last("live", "")
        hashes = live.select("hash").distinct()
        contents = self._known("contents", "hash string").join(hashes, "hash", "left_semi")
        terms = self._known("terms", TERMS).join(hashes, "hash", "left_semi")
        number = self.versions.write(live=live, frequency=self._last("frequency", ""), contents=contents, terms=terms)
        self.versions.remove(number)

    def index(self) -> Index:
        """The last version's index, ready to be asked."""
        n = self.versions.latest()
        if not n:
            raise ValueError("nothing was indexed")
        live, frequency = self.versions.read(n, "live"), self.versions.read(n, "frequency")
        if not self.versions.has(n, "blocks"):
            lasts = live.groupBy("hash").agg(F.max("chunk_id").alias("last"))
            self.versions.add(n, "blocks", blocks_of(self._known("terms", TERMS).join(lasts, "hash"), frequency, live.count()))
        return Index(self.versions.read(n, "blocks"), frequency, live.count(), live)

    def search(self, queries: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
        return self.index().search(queries, k)

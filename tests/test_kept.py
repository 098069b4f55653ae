"""Bounded retrieval, indexes and graphs that are kept up, strong components and the keyword automaton, against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.functions.automaton import Automaton, keyword_pairs, with_keywords
from codequarry.operators import components, graph, retrieval, search
from codequarry.operators.kept_graph import KeptGraph
from codequarry.sources.versions import Versions


def plain_top(chunks: list[tuple], queries: list[tuple], k: int) -> set[tuple]:
    words = lambda t: re.findall(r"[a-zA-Z_]\w*", (t or "").lower())
    tf = [(i, Counter(words(t))) for i, t in chunks]
    df = Counter(w for _, c in tf for w in c)
    idf = {w: math.log(len(chunks) / (n + 1)) for w, n in df.items()}
    vector = lambda c: {w: n * idf[w] for w, n in c.items() if idf.get(w)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = set()
    for q, text in queries:
        a = vector(Counter(words(text)))
        scored = []
        for i, c in tf:
            v = vector(c)
            if dot := sum(x * v[w] for w, x in a.items() if w in v):
                scored.append((round(dot / norm(a) / norm(v), 6), i))
        out |= {(q, r, i, s) for r, (s, i) in enumerate(sorted((x for x in scored if x[0] > 0), reverse=True)[:k], 1)}
    return out


def some_chunks(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    rows = [(f"c{i:04d}", " ".join(r.choices(vocabulary, weights, k=r.randint(0, 40)))) for i in range(n)]
    return [*rows, ("d1", rows[3][1]), ("d2", rows[3][1]), ("d3", rows[3][1]), ("e1", None), ("e2", ""), ("e3", "w79"), ("e4", "w79 w79"), ("e5", "everything")]


def asked(seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(i, " ".join(r.choices([f"w{j}" for j in range(80)], k=r.randint(1, 12)))) for i in range(12)] + [(90, None), (91, "unknown"), (92, "w79"), (93, "w0 w0 w1")]


def hits(df) -> set[tuple]:  # noqa: ANN001
    return {tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect()}


@pytest.mark.parametrize(("size", "rounds", "at_once"), [(32, (1, 4, 16, 64), 10**6), (4, (1, 3), 30)])
def test_bounded_search_is_exact(spark, monkeypatch, size, rounds, at_once):  # noqa: ANN001
    for name, value in (("SIZE", size), ("ROUNDS", rounds), ("AT_ONCE", at_once), ("RARE", 20)):
        monkeypatch.setattr(search, name, value)
    chunks, queries = some_chunks(1, 220), asked(2)
    index = search.index_of(spark.createDataFrame(chunks, "chunk_id string, content string"))
    questions = spark.createDataFrame(queries, "query_id long, content string")
    assert hits(index.search(questions, 3)) == plain_top(chunks, queries, 3)
    made, every = index.products(questions, 3)
    assert 0 < made < every


def test_terms_are_counted_in_their_rows(spark):  # noqa: ANN001
    chunks = spark.createDataFrame([("a", "x Y y"), ("a", "x z"), (None, "x"), (None, "q x"), ("b", "1 \n"), ("c", None)], "chunk_id string, content string")
    terms = retrieval.term_arrays(chunks)
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    found, n = retrieval.chunk_terms(chunks)
    got = {(r.chunk_id, t.token, t.tf) for r in found.collect() for t in r.terms}
    assert n == 6 and got == {("a", "x", 2), ("a", "y", 2), ("a", "z", 1), (None, "x", 2), (None, "q", 1)}
    assert hits_of(retrieval.frequencies(found)) == {("x", 4, 2), ("y", 2, 1), ("z", 1, 1), ("q", 1, 1)}


def hits_of(df) -> set[tuple]:  # noqa: ANN001
    return {tuple(r) for r in df.collect()}


def test_tokens_that_are_not_broadcast_keep_their_weights(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(retrieval, "BROADCAST", 10)
    chunks, queries = some_chunks(7, 120), asked(8)
    index = search.index_of(spark.createDataFrame(chunks, "chunk_id string, content string"))
    common, rare = retrieval.common_and_rare(retrieval.inverse_frequencies(index.frequency, index.n))
    assert 0 < common.count() <= 12 and rare.count() > 50
    assert hits(index.search(spark.createDataFrame(queries, "query_id long, content string"), 3)) == plain_top(chunks, queries, 3)


def test_search_of_nothing(spark):  # noqa: ANN001
    none = spark.createDataFrame([], "chunk_id string, content string")
    some = spark.createDataFrame([("a", "x y")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "x")], "query_id long, content string")
    assert search.top_chunks(none, queries).count() == 0 and search.top_chunks(some, queries.where("false")).count() == 0


def test_kept_index_equals_a_new_one(spark, tmp_path):  # noqa: ANN001
    chunks, queries = some_chunks(3, 60), asked(4)
    questions = spark.createDataFrame(queries, "query_id long, content string")
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, content string")
    index = search.KeptIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="nothing"):
        index.index()
    assert index.update(frame(chunks)) == {"added": len(chunks), "changed": 0, "removed": 0, "contents_cut": len({t or "" for _, t in chunks})}
    assert hits(index.search(questions)) == plain_top(chunks, queries, 5)
    later = [(i, t) if n % 7 else (i, f"{t} w78 fresh{n}") for n, (i, t) in enumerate(chunks) if n % 5] + [("new", "w5 w6"), ("copy", chunks[3][1])]
    old = dict(chunks)
    fresh = {t for i, t in later if t not in set(old.values())}
    told = index.update(frame(later))
    assert told["contents_cut"] == len(fresh) and told["removed"] == len(set(old) - {i for i, _ in later}) and told["added"] == 2
    assert hits(index.search(questions)) == plain_top(later, queries, 5)
    index.merge()
    assert index.versions.numbers() == [3] and hits(search.KeptIndex(spark, str(tmp_path / "index")).search(questions)) == plain_top(later, queries, 5)
    assert index.update(frame(later)) == {"added": 0, "changed": 0, "removed": 0, "contents_cut": 0}
    assert index.update(frame(later[:0]))["removed"] == len(later) and hits(index.search(questions)) == set()


def test_half_written_versions_are_not_read(spark, tmp_path):  # noqa: ANN001
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.latest() == 0
    versions.write(a=spark.range(3))
    with pytest.raises(Exception, match="no such column|UNRESOLVED|cannot resolve|DIVIDE"):
        versions.write(a=spark.range(2), b=spark.range(2).select(F.expr("1 / (id - id)")))
    assert versions.numbers() == [1] and versions.read(1, "a").count() == 3


# ---- graphs


def links_of(files):  # noqa: ANN001, ANN201
    rows = files.select("id", F.posexplode(F.split("content", " ")).alias("no", "module")).where("module <> ''")
    return rows.withColumn("candidates", F.array(F.concat("module", F.lit(".x")), F.concat(F.lit("lib/"), "module", F.lit(".x"))))


def plain_links(files: list[tuple]) -> set[tuple]:
    paths = {p for _, p, _ in files}
    return {
        (i, n, p, m, next((c for c in (f"{m}.x", f"lib/{m}.x") if c in paths), None)) for i, p, t in files for n, m in enumerate((t or "").split(" ")) if m
    }


def test_kept_graph_equals_a_new_one(spark, tmp_path):  # noqa: ANN001
    frame = lambda rows: spark.createDataFrame(rows, "id long, path string, content string")
    kept = KeptGraph(spark, str(tmp_path / "g"), links_of, lambda path: F.array(path))
    one = [(1, "a.x", "b c d"), (2, "b.x", "a"), (3, "lib/c.x", "a a"), (4, "e.x", None), (5, "f.x", "c e")]
    assert kept.update(frame(one)) == {"files_parsed": 5, "files_removed": 0, "links_resolved": 8, "links_kept": 0}
    found = lambda: {tuple(r) for r in kept.links().select("id", "no", "source", "module", "target").collect()}
    assert found() == plain_links(one)
    # c.x takes precedence of lib/c.x, d appears, b goes, f changes, a second file provides e.x
    two = [(1, "a.x", "b c d"), (3, "lib/c.x", "a a"), (4, "e.x", None), (5, "f.x", "e"), (6, "c.x", "b"), (7, "d.x", ""), (8, "e.x", "f")]
    assert kept.update(frame(two)) == {"files_parsed": 4, "files_removed": 1, "links_resolved": 6, "links_kept": 2}
    assert found() == plain_links(two)
    assert kept.update(frame(two))["links_resolved"] == 0 and found() == plain_links(two)


def plain_components(edges: list[tuple]) -> dict:
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    ids = {x for e in edges for x in e}

    def reach(x):  # noqa: ANN001, ANN202
        seen, todo = {x}, [x]
        while todo:
            for y in after[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    reached = {x: reach(x) for x in ids}
    return {x: min(y for y in reached[x] if x in reached[y]) for x in ids}


@pytest.mark.parametrize(("n", "m"), [(40, 55), (12, 40), (30, 20)])
def test_strong_components(spark, n, m):  # noqa: ANN001
    r = random.Random(n)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(9)]
    got = {x.id: x.component for x in components.strong_components(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(77,), (0,)], "id long")).collect()}
    assert got == {77: 77, 0: 0, **plain_components(edges)}
    inner = {tuple(x) for x in components.inner_edges(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert inner == {(a, b) for a, b in edges if a != b and got[a] == got[b]}


def test_components_of_nothing(spark):  # noqa: ANN001
    none = spark.createDataFrame([], "src string, dst string")
    assert components.strong_components(none).count() == 0
    assert [tuple(x) for x in components.strong_components(spark.createDataFrame([("a", "a")], "src string, dst string"), spark.createDataFrame([("a",)], "id string")).collect()] == [("a", "a")]


def test_order_without_the_driver(spark):  # noqa: ANN001
    r = random.Random(8)
    items = [(f"i{k}", k * 7 % 50) for k in range(50)]
    needs = [(f"i{r.randrange(50)}", f"i{r.randrange(50)}") for _ in range(45)] + [("i1", "unknown"), ("i3", "i3")]
    a, b = spark.createDataFrame(items, "id string, ord int"), spark.createDataFrame(needs, "id string, on string")
    ranks = [x.id for x in graph.topological_ranks(a, b).orderBy("place").collect()]
    assert ranks == graph.topological_order(a, b) and len(ranks) == 50


# ---- keywords


def test_automaton_finds_every_keyword():
    r = random.Random(3)
    keywords = ["a", "ab", "bab", "bc", "bca", "c", "caa", "é", "éa", "", "aaaa"]
    texts = ["", "abccab", "éaé" * 5, "x" * 10] + ["".join(r.choice("abcé ") for _ in range(r.choice((5, 300, 9000)))) for _ in range(40)]
    auto = Automaton(keywords)
    raws = [t.encode() for t in texts]
    got = Counter(zip(*(x.tolist() for x in auto.matches(raws)), strict=True))
    want = Counter((i, m.end(), k) for i, raw in enumerate(raws) for k, w in enumerate(keywords) if w for m in re.finditer(b"(?=" + re.escape(w.encode()) + b")", raw) for m in [_End(m.start() + len(w.encode()))])
    assert got == want
    text, keyword = auto.contained(raws)
    assert set(zip(text.tolist(), keyword.tolist(), strict=True)) == {(i, k) for i, t in enumerate(texts) for k, w in enumerate(keywords) if w and w in t}


class _End:
    def __init__(self, end: int):
        self._end = end

    def end(self) -> int:
        return self._end


def test_keywords_of_rows(spark, monkeypatch):  # noqa: ANN001
    from codequarry.functions import automaton

    rows = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "twone")], "id long, text string")
    got = {r.id: r.k for r in with_keywords(rows, "text", ["two", "one", "two", "", "three"], "k").collect()}
    assert got == {1: ["two", "one"], 2: [], 3: [], 4: ["two", "one"]}
    assert all(r.k == [] for r in with_keywords(rows, "text", [], "k").collect())
    monkeypatch.setattr(automaton, "STATES", 8)
    words = spark.createDataFrame([(w,) for w in ("two", "one", "won", "three", "", "two", None)], "keyword string")
    assert {tuple(r) for r in keyword_pairs(rows, words).collect()} == {(1, "two"), (1, "one"), (4, "two"), (4, "one"), (4, "won")}
    assert np.array_equal(Automaton([]).contained([b"x"])[0], np.zeros(0))


def test_a_turn_of_components_writes_one_table(spark, monkeypatch):  # noqa: ANN001
    made, keep, n = [], components.written, 8
    monkeypatch.setattr(components, "written", lambda df: made.append(1) or keep(df))
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    assert {tuple(r) for r in components.strong_components(ring).collect()} == {(i, 0) for i in range(n)}
    assert len(made) <= 2 * n + 9

"""Every query with SQL gives what DuckDB gives; the others run."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from codequarry.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(pdf) -> list[tuple]:  # noqa: ANN001
    def cell(v):  # noqa: ANN001, ANN202
        if isinstance(v, list) or getattr(v, "ndim", 0):
            return str(list(v))
        if v is None or v != v:
            return ""
        return str(round(v, 5)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):  # noqa: ANN001
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def plain_rank(ids: set, edges: set, turns: int = 20) -> dict:
    edges = {(a, b) for a, b in edges if a != b}
    ids = ids | {x for e in edges for x in e}
    deg, score = Counter(a for a, _ in edges), dict.fromkeys(ids, 1 / len(ids))
    for _ in range(turns):
        loose = sum(score[i] for i in ids if not deg[i]) / len(ids)
        new = dict.fromkeys(ids, 0.85 * loose + 0.15 / len(ids))
        for a, b in edges:
            new[b] += 0.85 * score[a] / deg[a]
        score = new
    return score


def test_graphs_of_whole_tables(spark, sf_dir):  # noqa: ANN001
    t = {n: duckdb.sql(f"SELECT * FROM '{sf_dir}/{n}.parquet'").df() for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    customer, home, base = (
        dict(t[n][list(c)].itertuples(index=False)) for n, c in (
            ("orders", ("o_orderkey", "o_custkey")), ("customer", ("c_custkey", "c_nationkey")), ("supplier", ("s_suppkey", "s_nationkey"))
        )
    )
    region = dict(t["nation"][["n_nationkey", "n_regionkey"]].itertuples(index=False))
    pairs = {(customer[o], s) for o, s in t["lineitem"][["l_orderkey", "l_suppkey"]].itertuples(index=False)}
    trade, buys = {(base[s], home[c]) for c, s in pairs}, {(f"c{c}", f"s{s}") for c, s in pairs}
    rows = lambda name: {tuple(r) for r in QUERIES[name](spark, sf_dir).collect()}
    assert rows("module_dependencies") == {(f"r{region[a]}", f"r{region[b]}") for a, b in trade if region[a] != region[b]}
    near = defaultdict(set)
    for a, b in buys:
        near[a].add(b)
        near[b].add(a)
    assert rows("related_files_d1") == {(s, x, 1) for s in ("s1", "s2") for x in near[s]}
    assert rows("related_files_d2") == {("s1", x, 1) for x in near["s1"]} | {("s1", y, 2) for x in near["s1"] for y in near[x] if y != "s1" and y not in near["s1"]}
    ranks = {"pagerank_files": plain_rank(set(region), trade), "pagerank_symbols": plain_rank({f"c{c}" for c in home} | {f"s{s}" for s in base}, buys)}
    for name, want in ranks.items():
        got = dict(rows(name))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_ranking_stops_when_it_is_settled(spark, sf_dir):  # noqa: ANN001
    from codequarry.operators.graph import page_rank
    from codequarry.plans.catalog import _links

    links = {(r.source_file, r.target_file) for r in _links(spark, sf_dir).where("not is_external").collect()}
    edges = spark.createDataFrame(sorted(links), "src string, dst string")
    ids = {x for e in links for x in e}
    want = plain_rank(ids, links, 200)
    for tolerance in (1e-4, 1e-7):
        got = {r.id: r.score for r in page_rank(edges.selectExpr("src AS id"), edges, tolerance=tolerance).collect()}
        # a turn moves scores by 0.85 of the turn before at most, so what is left is under 0.85 / 0.15 of the last move
        assert got.keys() == ids and sum(abs(got[i] - want[i]) for i in ids) < len(ids) * tolerance * 6


def test_ranking_computes_edges_once_and_sends_sums_only(spark, monkeypatch):  # noqa: ANN001
    from codequarry import session
    from codequarry.operators import graph, vertices

    pairs = [(f"a{i}", "hub") for i in range(60)] + [(f"a{i}", f"b{i % 7}") for i in range(60)] + [("hub", "a1"), ("b1", "b2"), ("b1", "b2"), ("b3", "b3")]
    ids, made, plans = {"a1", "lone"}, spark.sparkContext.accumulator(0), []
    want = plain_rank(ids, set(pairs), 6)

    def check() -> None:
        edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(lambda pair: made.add(1) or pair), "src string, dst string")
        got = {r.id: r.score for r in graph.page_rank(spark.createDataFrame([(i,) for i in ids], "id string"), edges, most=6, tolerance=0).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)

    keep, before = graph.written, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(graph, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check()
        assert made.value == len(pairs)
        assert len(plans) == 8 and not any("Exchange hashpartitioning(src" in p or "Exchange hashpartitioning(shiftright(src" in p for p in plans[2:])
        # beyond what may be broadcast: the same rows by joins that shuffle
        monkeypatch.setattr(vertices, "BROADCAST", 0)
        plans.clear()
        check()
        assert all("SortMergeJoin [shiftright(src" in p for p in plans[2:])
        # the edges of a much wanted vertex go to several tasks
        monkeypatch.setattr(session, "TASK", 8)
        monkeypatch.setattr(vertices, "BUCKET", 2)
        tasks = []
        monkeypatch.setattr(vertices.Vertices, "numbered", lambda self, *a, f=vertices.Vertices.numbered: tasks.append(self.names.selectExpr("inline(arrays_zip(ids, spreads))").where("ids = 'hub'").first()) or f(self, *a))
        check()
        assert tasks[0].spreads == 8
        # ids of one hash
        seeds = []
        monkeypatch.setattr(vertices, "_hash", lambda key, seed, f=vertices._hash: seeds.append(seed) or (f(key, seed) if seed else F.pmod(f(key, seed), F.lit(5))))
        check()
        assert set(seeds) == {0, 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entry(spark):  # noqa: ANN001
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Quality, mixture, similarity join, repeats, decontamination and the pipeline against plain versions, and with odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from cases import all_ids, empty, ids, odd, prose
from pyspark.sql import functions as F

from codequarry.llm import decontaminate, jaccard, mixture, quality, repeats
from codequarry.llm.common import word_hashes
from codequarry.llm.components import components
from codequarry.llm.suffixes import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- quality


def plain_counts(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_counts_match_plain_ones(spark):  # noqa: ANN001
    texts = [
        "a b c a b c", "x x x x x", "a\na\n\n \na", "#*$ | é🎉 \x0b\x0c\r z", "", None, "a b c d a b c", "    w", " lead  trail "
    ] + [prose(i, 60 * i) for i in range(1, 6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r.s) for r in docs.select("doc_id", quality.text_stats(F.col("text")).alias("s")).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in whole.select("text", quality.text_stats(F.col("text")).alias("s")).collect():
        assert tuple(r.s) == plain_counts(r.text)


def test_outliers_go_and_clean_texts_stay(spark):  # noqa: ANN001
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    got = quality.op3_quality(spark, d).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.999 and np.mean([r.kept for r in got if r.quality == 0]) < 0.05


def plain_determinant(x: np.ndarray, weights: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps over weighted cells, by numpy."""
    every = np.repeat(x, weights, axis=0)

    def lower_percentile(v: np.ndarray, q: float) -> float:
        v = np.sort(v)
        return float(np.interp(q * (len(v) - 1), np.arange(len(v)), v))

    floor = np.array(quality.FLOOR)
    m = np.array([lower_percentile(c, 0.5) for c in every.T])
    scatter = np.diag([(1.4826 * lower_percentile(abs(c - k), 0.5)) ** 2 + f**2 for c, k, f in zip(every.T, m, floor)])
    for _ in range(steps):
        dist = np.round(np.einsum("ij,jk,ik->i", every - m, np.linalg.inv(scatter), every - m), 6)
        half = every[dist <= lower_percentile(dist, quality.HALF)]
        m, scatter = half.mean(axis=0), quality.CONSISTENT * np.cov(half.T, bias=True) + np.diag(floor**2)
    return m, scatter


def test_estimates_match_plain_steps(spark):  # noqa: ANN001
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = quality.count_texts(docs).where("not base_failed")
    found = {r.g: r for r in quality.estimates(counted).collect()}
    rows = counted.select(*(x.alias(f"x{i}") for i, x in enumerate(quality._statistics()))).toPandas().to_numpy()
    grid = np.array(quality.GRID)
    m, scatter = plain_determinant(np.round(rows / grid) * grid, np.ones(len(rows), dtype=int), quality.STEPS)
    low = np.array([[found["{}"][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose([found["{}"][f"m{i}"] for i in range(4)], m, atol=2e-3)
    assert np.allclose(low @ low.T, scatter, rtol=0.1, atol=2e-3)


def test_quality_of_odd_rows(spark):  # noqa: ANN001
    docs = odd(spark)
    got = quality.judge(docs)
    assert ids(got) == all_ids()
    assert not got.where("doc_id in (1, 2, 3, 7, 8) and kept").count()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and set(ids(kept)) <= set(all_ids()) and 20 in ids(kept)
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


# ---- mixture


def plain_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0)
    free, left = set(names), total
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixture(spark):  # noqa: ANN001
    d = "/root/testdata/sf0.01"
    got = mixture.op4_mixture(spark, d).toPandas()
    sizes = got.groupby("source")["size"].sum().to_dict()
    for s, t in plain_targets(sizes).items():
        own = got[got.source == s]
        assert np.isclose(own.target.iloc[0], t) and abs(own.taken.sum() - t) <= mixture.BLOCK and own.source_size.iloc[0] == sizes[s]
    assert (got.taken <= 2 * got["size"]).all()
    again = mixture.op4_mixture(spark, d).toPandas()
    assert again.sort_values("doc_id").reset_index(drop=True).equals(got.sort_values("doc_id").reset_index(drop=True))


def test_blocks_hold_what_documents_give(spark):  # noqa: ANN001
    docs = spark.createDataFrame([(i, prose(i, 30 + 7 * i), "a" if i % 3 else None) for i in range(30)], "doc_id long, text string, source string")
    taken = Counter()
    for r in mixture.mixed_blocks(docs, block=16).collect():
        taken[r.source] += len(r.text.split())
    want = Counter()
    for r in mixture.mix(docs, block=16).collect():
        want[r.source] += r.taken
    assert taken == want and set(taken) == {"a", None}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 65, 997])
def test_permutation(spark, n):  # noqa: ANN001
    p = spark.range(n).select("id", mixture.permuted(F.col("id"), F.lit(n), F.lit(11)).alias("p")).collect()
    assert sorted(r.p for r in p) == list(range(n))
    assert n < 10 or sum(r.p == r.id for r in p) < n / 4


def test_shards_draw_counts_that_fill_them(spark):  # noqa: ANN001
    goals = spark.createDataFrame(
        [("a", 64_000, 96_000.0), ("b", 30_000, 60_000.0), (None, 6_400, 6_400.0), ("empty", 0, 0.0)],
        "source string, source_size long, target double"
    )
    slots = mixture.draw(goals, block=16, shard=100).toPandas()
    wanted = {"=a": 6000, "=b": 3750, "": 400}
    assert slots.groupby("name").size().to_dict() == wanted
    sizes = slots.groupby("shard").size()
    assert sorted(sizes) == [50] + [100] * 101  # every shard is full but the last
    counts = slots.groupby(["name", "shard"]).size().unstack(fill_value=0)
    for name, n in wanted.items():  # near the multinomial's mean and variance
        p = n / 10_150
        full = counts.loc[name, sizes[sizes == 100].index]
        assert abs(full.mean() - 100 * p) < 1.5 and 0.5 < full.var() / (100 * p * (1 - p)) < 1.7
        own = slots[slots.name == name].sort_values("k")
        assert own.k.tolist() == list(range(n)) and own.shard.is_monotonic_increasing  # prefix sums number the slots
    for (name, turn), own in slots.groupby(["name", "pass"]):
        assert own.block.is_unique and own.block.between(0, {"=a": 3999, "=b": 1874, "": 399}[name]).all()


def test_mixture_of_odd_rows(spark):  # noqa: ANN001
    docs = odd(spark)
    got = mixture.mix(docs)
    assert ids(got) == all_ids() and not got.where("taken > 2 * size or taken is null or target is null").count()
    assert got.where("doc_id = 1").first().taken == 0
    assert mixture.mix(empty(spark)).count() == 0
    assert mixture.mix(docs.where("text is null")).agg(F.sum("taken")).first()[0] == 0


# ---- similarity join


def plain_classes(rows: list[tuple], percent: int, n: int) -> dict:
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    big = 2**63
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), big), big if i is None else i)
    return Counter((i, len(sets[k]), None if least[root(k)] == big else least[root(k)]) for k, (i, _) in enumerate(rows))


def near_copies(seed: int, groups: int, copies: int, words: int, edits: int) -> list[tuple]:
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(1000 * seed + g, words).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009 + seed * 2000, " ".join(w)))
    return rows


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_classes_match_brute_force(spark, percent, n):  # noqa: ANN001
    rows = near_copies(1, 6, 25, 120, 5) + near_copies(2, 20, 4, 15, 1) + near_copies(3, 3, 6, 400, 9) + [
        (9001, None), (9002, ""), (9003, "a b"), (9004, "A B"), (9005, "b a")
    ]
    shared = prose(77, 50)
    rows += [(9100 + i, f"{shared} {prose(500 + i, 30)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(docs, percent, n).collect())
    assert got == plain_classes(rows, percent, n)


def test_repeated_tables_lose_no_link(spark, monkeypatch, tmp_path):  # noqa: ANN001
    monkeypatch.setattr(jaccard, "MEETINGS", 0)
    rows = [(None, None), (None, None), *near_copies(6, 8, 9, 90, 4), *near_copies(7, 12, 3, 20, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "a"))
    docs.write.mode("append").parquet(str(tmp_path / "a"))
    for twice in (docs.union(docs), spark.read.parquet(str(tmp_path / "a"))):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(twice).collect())
        assert got == plain_classes(rows + rows, 90, 3)


def test_shingles_with_one_membership_are_told_once(spark):  # noqa: ANN001
    signed = spark.createDataFrame([(r, [1, 2]) for r in (10, 20)] * 2 + [(30, [2, 3]), (40, [3])], "rid long, prefix array<long>")
    got = sorted((r.token, r.rid) for r in jaccard._routes(signed).collect())
    assert got == [(1, 10), (1, 20), (2, 10), (2, 20), (2, 30), (3, 30), (3, 40)]


def test_large_tiles_are_cut(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(jaccard, "TILE", 8)
    rows = near_copies(4, 2, 40, 60, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(docs).collect())
    assert got == plain_classes(rows, 90, 3)


def test_join_of_odd_rows(spark):  # noqa: ANN001
    docs = odd(spark)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(docs).collect())
    assert got == plain_classes([(r.doc_id, r.text) for r in docs.collect()], 90, 3)
    kept = jaccard.keep_first(docs, 80, 5)
    assert set(kept.columns) == set(docs.columns) and ids(kept).count(6) == 0 and ids(kept).count(5) == 1 and {1, 2, 3, 10 + 5} <= set(ids(kept))
    assert jaccard.similar_classes(empty(spark)).count() == 0 and jaccard.keep_first(empty(spark), 80, 5).count() == 0


def test_first_rows_are_told_apart_by_id_and_text(spark):  # noqa: ANN001
    base, other = prose(21, 120), prose(22, 120)
    near = lambda t, k: " ".join(t.split()[:-1] + [f"edit{k}"])
    rows = [
        (1, base, 1), (2, near(base, 1), 2), (2, prose(23, 60), 3), (None, near(base, 2), 4), (None, other, 5), (None, near(other, 1), 6),
        (None, near(other, 2), 7), (None, None, 8)
    ]
    rows += [(3, prose(24, 120), 9), (3, near(prose(24, 120), 1), 10), (4, prose(25, 50), 11), (4, prose(25, 50), 12), (4, prose(26, 50), 13), (None, prose(27, 50), 14)]
    kept = [r.row for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, row int"), 80, 5).collect()]
    groups = [{1, 2, 4}, {3}, {5, 6, 7}, {8}, {9, 10}, {11, 12}, {13}, {14}]
    assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups) and 1 in kept


def test_components(spark):  # noqa: ANN001
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_word_hashes_depend_on_the_word_alone():
    one = word_hashes(np.frombuffer(b"  Alpha beta\tALPHA\x0bgamma alpha", dtype=np.uint8))[0]
    assert one[0] == one[2] == one[4] and len(set(one.tolist())) == 3


# ---- repeats


def plain_repeats(rows: list[tuple], n: int = repeats.SPAN) -> list[tuple]:
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + n] for _, b in data for s in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if count[b[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for k, x in enumerate(b) if not gone[k])).hexdigest()))
    return sorted(out, key=str)


def repeat_rows() -> list[tuple]:
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 200)
    rows = [(i, f"{prose(10 + i, 20)} {a} {prose(40 + i, 20)}") for i in range(12)] + [(20 + i, f"{b}{prose(70 + i, 9)}") for i in range(8)]
    rows += [
        (40, c), (41, c), (42, c[50:]), (43, "ab" * 400), (44, "x" * 199), (45, "x" * 200), (46, "é" * 150), (47, ("line of words " * 3 + "\n") * 30),
        (48, None), (49, "")
    ]
    rows += [(60 + i, c[:400] + f" edit{i} " + c[407:]) for i in range(10)]
    return rows


@pytest.mark.parametrize("limit", [400, 2])
def test_repeats_match_brute_force(spark, limit):  # noqa: ANN001
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs, limit)
    assert sorted((tuple(r) for r in got.drop("spans").collect()), key=str) == plain_repeats(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.collect())


def test_repeats_of_odd_rows(spark):  # noqa: ANN001
    docs = odd(spark).where("doc_id is null or doc_id <> 4")
    got = repeats.remove_repeats(docs).drop("spans")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_suffix_array_by_grouping():
    r = random.Random(5)
    for k in range(600):
        x = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(1, 50))]
        x = ([1] * len(x) if k % 9 == 0 else (x[:4] * 20)[: len(x)] if k % 7 == 0 else x) + [0]
        order = suffix_array(x)
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        assert all(x[a : a + h] == x[b : b + h] and x[a : a + h + 1] != x[b : b + h + 1] for a, b, h in zip(order, order[1:], common_prefixes(x, order)[1:]))


# ---- decontamination


def plain_contained(docs: list[tuple], items: list[tuple]) -> set:
    def grams(text: str | None) -> set:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, grams(t)) for i, t in items]
    return {(d, i, len(s), len(s & g)) for d, t in docs for g in [grams(t)] for i, s in sets if s and len(s & g) >= 0.8 * len(s)}


@pytest.mark.parametrize("in_plan", [decontaminate.SIGNATURES_IN_PLAN, 0])
def test_contained_items(spark, in_plan):  # noqa: ANN001
    items = [(i, prose(900 + i, 12 + 3 * i)) for i in range(8)] + [(20, "one two"), (21, None), (22, "!!"), (23, "")]
    docs = [(i, prose(i, 100)) for i in range(20)]
    docs += [(30 + i, f"{prose(i, 60)} {items[i][1].upper()}! {prose(99 + i, 60)}") for i in range(8)]
    cut = [" ".join(items[i][1].split()[: int(len(items[i][1].split()) * 0.9)]) for i in range(8)]
    docs += [(50 + i, f"{prose(i + 7, 500)} {cut[i]} {prose(i + 70, 900)}") for i in range(8)] + [(70, "one two"), (71, None), (72, "")]
    got = decontaminate.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), in_plan=in_plan
    )
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got.collect()} == plain_contained(docs, items)


def test_decontamination_of_odd_rows(spark):  # noqa: ANN001
    docs = odd(spark)
    items = spark.createDataFrame([(1, prose(10, 90), "k"), (2, None, "k"), (None, prose(11, 91), "k")], "item_id long, text string, key string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()}
    assert {(5, 1), (6, 1), (10, 1), (None, None), (11, None)} == got
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and not set(ids(kept)) & {5, 6, 10, 11} and 12 in ids(kept)
    assert ids(decontaminate.keep_clean(docs, items.where("false"))) == all_ids()
    assert decontaminate.contained_items(empty(spark), items).count() == 0


@pytest.mark.parametrize("in_plan", [decontaminate.SIGNATURES_IN_PLAN, 0])
def test_short_items_are_found_inside_long_documents(spark, in_plan):  # noqa: ANN001
    items = [(1, "zeta"), (2, "Alpha beta!"), (3, "one two three"), (4, "one two three four"), (5, prose(900, 20)), (6, "beta alpha"), (7, "")]
    docs = [
        (1, f"{prose(1, 60)} alpha, Beta {prose(2, 60)}"), (2, f"{prose(3, 9)} one two three four {items[4][1]}"), (3, "zeta"), (4, "two three four"),
        (5, "one two three"), (6, f"zeta {prose(4, 30)} alpha"), (7, "beta alpha zeta x"), (8, None)
    ]
    got = decontaminate.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), in_plan=in_plan
    )
    want = {(1, 2), (2, 3), (2, 4), (2, 5), (3, 1), (5, 3), (6, 1), (7, 1), (7, 6)}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and all(r.shared == r.item_shingles == 1 for r in got.collect() if r.item_id < 5)


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):  # noqa: ANN001
    rows = [(None, prose(11, 91), 1), (None, None, 2), (None, prose(12, 40), 3), (1, prose(11, 91), 4), (1, prose(13, 40), 5), (1, prose(13, 40), 6), (2, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    items = spark.createDataFrame([(1, prose(11, 91))], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [2, 3, 5, 6, 7]
    held = decontaminate.contained_items(odd(spark), items).select("doc_id").collect()
    clean = decontaminate.keep_clean(odd(spark), items)
    assert {r.doc_id for r in held} == {None, 11} and clean.where("doc_id is null and text is null").count() == 1


# ---- pipeline


def test_pipeline(spark, tmp_path):  # noqa: ANN001
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = ids(docs)
        assert name == "mixture" or set(docs.columns) == set(columns)
        if name == "quality":
            assert kept[name] == ids(quality.judge(before).where("kept"))
        elif name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert kept[name] == sorted({c for _, n, c in plain_classes(rows, 80, 5) if n} | {i for i, n, _ in plain_classes(rows, 80, 5) if not n})
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            bad = {x[0] for x in plain_contained([(r.doc_id, r.text) for r in before.collect()], items)}
            assert kept[name] == sorted(set(ids(before)) - bad)
        else:
            assert kept[name] == ids(before)
    assert corpus_pipeline.run(spark, d).count() == len(kept["mixture"])


def test_stages_take_odd_and_empty_tables(spark, tmp_path):  # noqa: ANN001
    d = "/root/testdata/sf0.001"
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert set(out.columns) == set(docs.columns) and set(ids(out)) <= set(ids(docs))
        assert ids(corpus_pipeline.STAGES[-1][1](spark, docs, d)) == ids(docs)

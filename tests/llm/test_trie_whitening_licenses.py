"""Prefix trie, whitening and license scan against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import empty, odd, prose

from codequarry.llm import licenses, trie, whitening

# ---- prefix trie


def plain_trie(rows: list[tuple]) -> list[tuple]:
    """Nodes of rows(conv_id, turn, role, text), whose turn numbers differ unless the rows are equal."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, sums = [], {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in kids[k]) or 1
        saved = sum(sums[x][1] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        sums[k] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
        up = min(members[k[:-1]]) if k else None
        out.append((min(members[k]), len(k), up, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found_trie(spark, rows: list[tuple]) -> list[tuple]:  # noqa: ANN001
    talks = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, pos int")
    return sorted((tuple(r) for r in trie.prefix_trie(*trie.rebuilt(talks)).collect()), key=lambda r: r[:2])


def odd_talks() -> list[tuple]:
    r = random.Random(5)
    rows = [(c, t, r.choice("ua"), r.choice(["a", "bb", "ü"])) for c in range(60) for t in range(r.randint(1, 14))]
    rows += [(c, t, "u", f"long {t}") for c in (100, 200, 300) for t in range(40)]  # copies but for their heads
    rows += [(c, t, "u", f"long {t}" if t != 33 else f"own {c}") for c in (400, 405) for t in range(40)]
    rows += [(500, t, "u", f"alone {t}") for t in range(50)]
    rows += [(600, None, None, None), (600, 0, None, "x"), (600, 5, "u", None), (None, 1, "u", "lost"), (700, 1, "u", "twice"), (700, 1, "u", "twice")]
    rows += [(-3, 0, "u", "below"), (-3, 1, "u", "zero"), (-5, 0, "u", "below"), (801, 0, "u", "gone"), (2**53 + 1, 0, "u", "large"), (2**53 + 1, 1, "u", "larger")]
    return rows


@pytest.mark.parametrize(("segment", "local"), [(256, 2048), (5, 12), (16, 3)])
def test_trie_is_that_of_the_rebuilt_conversations(spark, monkeypatch, segment, local):  # noqa: ANN001
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "LOCAL", local)
    assert found_trie(spark, odd_talks()) == plain_trie(odd_talks())


def test_trie_of_few_rows(spark):  # noqa: ANN001
    assert found_trie(spark, []) == [] and found_trie(spark, [(None, 1, "u", "x")]) == []
    gone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5)
    assert found_trie(spark, [(gone, 0, "u", "x")]) == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]


def test_ids_that_end_at_a_node_are_hashed_in_pieces(spark):  # noqa: ANN001
    ids = spark.range(9_000_000, 9_030_000).selectExpr("0L AS top", "1L AS e1", "2L AS e2", "id AS conv_id")
    both = ids.union(spark.sql("SELECT 1L, 1L, 2L, 7L UNION ALL SELECT 1L, 1L, 2L, 11L")).repartition(7)
    got = {r.top: r.ends for r in trie.ends_of(both).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, range(9_000_000, 9_030_000))).encode()).hexdigest(), 1: hashlib.sha256(b"7,11").hexdigest()}


# ---- whitening


def plain_whitening(vectors: list[list[float]]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    points = np.unique(x, axis=0)
    n, s = len(points), points.sum(axis=0)
    y = (points * n - s) / n
    values, c = np.linalg.eigh(y.T @ y / n)
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    return deviation, ((x * n - s) / n) @ c[:, ::-1], values[::-1], c[:, ::-1]


def vectors_of(rng, n: int, d: int) -> np.ndarray:  # noqa: ANN001
    return (rng.standard_normal((n, d)) @ np.diag(np.linspace(3, 0.3, d)) + 5).astype(np.float32)


@pytest.mark.parametrize(("n", "d"), [(300, 70), (400, 24), (90, 5), (10, 30)])
def test_whitening_is_that_of_the_dense_eigenvectors(spark, n, d):  # noqa: ANN001
    vectors = vectors_of(np.random.default_rng(n), n, d).tolist()
    vectors += vectors[:3] * 4
    bad = [(-1, None), (-2, [None] * d), (-3, [float("nan")] + [0.0] * (d - 1)), (-4, [float("inf")] * d), (-5, [1.0] * (d + 1)), (-6, [])]
    rows = whitening.valid(spark.createDataFrame([*enumerate(vectors), *bad], "vec_id long, embedding array<float>"))
    model = whitening.fit(rows)
    deviation, projected, values, _ = plain_whitening(vectors)
    k = min(16, d, n - 1)
    assert model.points.n == n and len(model.values) == k and np.allclose(model.values, values[:k], rtol=1e-11)
    assert model.identity_error < 1e-9 and max(model.residuals) <= whitening.CERTIFIED * values[0]
    assert np.allclose(model.explained, values[:k] / values.sum(), rtol=1e-11)
    got = {r.vec_id: r for r in whitening.whiten(rows, model).collect()}
    assert sorted(got) == list(range(len(vectors)))
    assert [got[i].deviation for i in range(len(vectors))] == deviation
    mine = np.array([got[i].whitened for i in range(len(vectors))])
    want = projected[:, :k] / np.sqrt(values[:k])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * signs - want).max() < 1e-7


def test_whitening_of_few_or_large_values(spark):  # noqa: ANN001
    schema = "vec_id long, embedding array<float>, x int, label string"

    def of(vectors: list) -> whitening.Whitening:
        return whitening.fit(whitening.valid(spark.createDataFrame([(i, v, 1, "l") for i, v in enumerate(vectors)], schema)))

    for none in ([], [None], [[]], [[1.0, 2.0]] * 5):
        assert len(of(none).values) == 0
    model = of([[3e38, 0.0], [-3e38, 1.0], [0.0, 5.0]])
    assert len(model.values) == 1 and model.identity_error < 1e-6
    rows = whitening.valid(spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [r.deviation for r in whitening.whiten(rows, whitening.fit(rows)).orderBy("vec_id").collect()] == [None, None, None]


def test_whitening_query(spark, sf_dir):  # noqa: ANN001
    got = whitening.op11_whitening(spark, sf_dir)
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = got.collect()
    assert len(rows) == 16 * len(vectors) and {(r.vec_id, r.component) for r in rows} == {(i, c) for i in vectors for c in range(1, 17)}
    deviation, projected, values, _ = plain_whitening(list(vectors.values()))
    place = {i: k for k, i in enumerate(vectors)}
    assert all(r.deviation == deviation[place[r.vec_id]] and abs(abs(r.whitened) - abs(projected[place[r.vec_id], r.component - 1]) / np.sqrt(values[r.component - 1])) < 1e-6 for r in rows)
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-8 for r in rows)


# ---- licenses


def plain_base(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (i, label)
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(places)


def of_kind(matches: list, kind: str) -> list[tuple[int, str]]:
    return sorted((m.start, m.label) for m in matches if m.kind == kind)


def scanned(spark, texts: list[str | None]) -> list:  # noqa: ANN001
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(licenses.find_licenses(docs, licenses.build_index(docs)).collect())


def test_every_phrase_is_found(spark, monkeypatch):  # noqa: ANN001
    texts = [
        "MIT license, the Apache-License. GENERAL PUBLIC\nLICENSE", "mit licensed; apache  license2; general public a license", None, "", "mit", "license mit license mit license",
        "MİT license émit license mit license \U0001f389mit license", "mit\0license apache\tlicense", "general general public license public license",
        " ".join(["general public license mit"] * 50), "x " * 70_000 + "mit license " + "y " * 70_000 + "apache license",
    ]
    base = {phrase[1] for phrase in licenses.BASE_PHRASES}
    for text, r in zip(texts, scanned(spark, texts), strict=True):
        n, places = plain_base(text)
        assert r.n_words == n and [x for x in of_kind(r.matches, "phrase") if x[1] in base] == places, text
    monkeypatch.setattr(licenses, "STRETCH", 7)
    docs = spark.createDataFrame([(0, texts[9])], "doc_id long, text string")
    index = licenses.build_index(docs)
    some = licenses.Scanned([texts[9].encode()], index.vocabulary)
    assert sorted((m["start"], m["label"]) for m in index.matches(*some.text(0))) == plain_base(texts[9])[1]


def test_notices_are_found_when_edited_and_not_when_their_phrases_lack(spark):  # noqa: ANN001
    notices = {label: text for label, text, _ in reversed(licenses.NOTICES) if len(text) > 200}
    r = random.Random(2)
    texts, want = [], []
    for label, text in notices.items():
        words = text.split()
        texts.append(prose(1, 40) + "\n// " + "\n * ".join(text.split("\n")) + prose(2, 30))
        edited = [w for i, w in enumerate(words) if not (i > 0.7 * len(words) and r.random() < 0.05)]
        texts.append(" ".join(edited[: 3 * len(edited) // 4] + ["an", "insertion"] + edited[3 * len(edited) // 4 :]) if label not in ("gpl", "mit") else text)
        texts.append(" ".join(reversed(words)))
        want += [label, label, None]
    shuffled = notices["mit"].split()
    r.shuffle(shuffled)
    texts += [" ".join(shuffled), notices["mit"].replace("free of charge", "for a fee"), prose(3, 5000), "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    want += [None, None, None, "gpl", "cc-by-nc"]
    for text, label, row in zip(texts, want, scanned(spark, texts), strict=True):
        found = {m.label for m in row.matches if m.kind == "notice"}
        assert (label in found) if label else not found, (label, found, text[:80])
        assert all(licenses.SHARE <= m.score <= 1.0000001 for m in row.matches)


def test_license_query(spark, sf_dir):  # noqa: ANN001
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = licenses.op12_licenses(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        n, places = plain_base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({x[1] for x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_license_scan_of_odd_tables(spark):  # noqa: ANN001
    docs = odd(spark)
    got = licenses.find_licenses(docs, licenses.build_index(docs)).collect()
    assert len(got) == docs.count() and all(not r.matches for r in got)
    assert licenses.find_licenses(empty(spark), licenses.build_index(empty(spark))).collect() == []
    again = docs.selectExpr("doc_id", "concat(text, ' MIT License') AS text", "1 AS matches", "'k' AS n_words")
    found = licenses.find_licenses(again, licenses.build_index(again)).where("size(matches) > 0").count()
    assert found == again.where("text is not null").count()

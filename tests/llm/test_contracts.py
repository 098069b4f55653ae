"""Contracts of the queries against plain versions: ids and columns as they are, digests, models by plain arithmetic, damage of every byte."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from cases import prose
from pyspark.sql import functions as F
from test_text_scans import members, plain_persons, plain_secrets

from codequarry.llm import decontaminate, jaccard, langid, pii, quality, repeats, secrets, toxicity, warc
from codequarry.llm.common import durable, key_filter, passes

LARGE = 2**53 + 1


def large_ids(spark):  # noqa: ANN001, ANN201
    rows = [(LARGE, "token = abcdefgh12 a@b.cd", "en", "s"), (None, prose(1, 60), "en", None), (LARGE + 2, None, None, "s"), (LARGE + 4, prose(2, 60), "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_large_ids_beside_nulls_stay_as_they_are(spark, tmp_path):  # noqa: ANN001
    docs = large_ids(spark)
    want = {LARGE, LARGE + 2, LARGE + 4, None}
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    model = secrets.learn(docs)
    found = [
        langid.identify(docs, langid.fit(docs)), secrets.find_secrets(docs, model), pii.find_personal_data(docs), pii.sanitise(docs), toxicity.score(
            docs, toxicity.fit(docs, labels)
        ),
        jaccard.similar_classes(docs), repeats.remove_repeats(docs), quality.judge(docs),
    ]
    for df in found:
        assert {r.doc_id for r in df.select("doc_id").collect()} == want
    pages = spark.createDataFrame([(LARGE, "u", "same"), (LARGE + 2, "u", "same"), (None, "u", "same"), (5, "u", "other")], "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path))
    got = {(r.record_id, r.refers_to) for r in warc.read_archives(files, str(tmp_path)).collect()}
    assert got == {(f"<urn:page:{LARGE}>", None), (f"<urn:page:{LARGE + 2}>", f"<urn:page:{LARGE}>"), ("<urn:page:none>", f"<urn:page:{LARGE}>"), ("<urn:page:5>", None)}


def test_ids_of_other_types(spark):  # noqa: ANN001
    docs = large_ids(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for df in (secrets.find_secrets(docs, secrets.learn(docs)), pii.sanitise(docs), jaccard.similar_classes(docs)):
        assert {r.doc_id for r in df.select("doc_id").collect()} == {f"d{LARGE}", f"d{LARGE + 2}", f"d{LARGE + 4}", None}


def test_clashing_names_survive(spark):  # noqa: ANN001
    names = ("key", "KEY_", "__key", "spans", "__spans", "h", "batch")
    docs = large_ids(spark).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names) if n != "KEY_"))
    items = spark.createDataFrame([(1, prose(9, 20))], "item_id long, text string")
    for df in (quality.keep_good(docs), jaccard.keep_first(docs, 80, 5), decontaminate.keep_clean(docs, items), pii.sanitise(docs)):
        assert df.columns == docs.columns
        assert all(r["__key"] == 2 and r["spans"] == 3 and r["batch"] == 6 for r in df.collect()) and df.count() > 0


def test_filters_pass_all_their_keys(spark):  # noqa: ANN001
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    bits = key_filter(durable(spark.createDataFrame([(int(k),) for k in keys[:2500]] + [(None,)], "k long")))
    assert passes(bits, keys[:2500]).all() and passes(bits, keys[2500:]).mean() < 0.01


# ---- language


def test_language_model_is_plain_naive_bayes(spark, monkeypatch):  # noqa: ANN001
    syllables = {"aa": "ka lo mi", "bb": "zu re to", "cc": "ka re wi", "dd": "sho pli"}
    rows = [(i, prose(i, 30, syllables[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 6)]
    rows += [(100, "Ка\U00030000 ка", None), (101, "\U00030000", None), (102, "123 !", None), (103, "kalo ZURE", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def buckets(text: str) -> Counter:
        cleaned = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", text.lower(), flags=re.DOTALL)
        words = "".join(c if c.isalpha() else " " for c in cleaned).split()
        line, out = f" {' '.join(words)} " if words else "", Counter()
        for n in langid.ORDERS:
            for i in range(len(line) - n + 1):
                h = 0
                for c in line[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                out[((h * 0x9E3779B97F4A7C15 + n * 0xD6E8FEB86659FD93) % 2**64 >> 48) % langid.BUCKETS] += 1
        return out

    counts = {lang: sum((buckets(t) for _, t, x in rows if x == lang), Counter()) for lang in syllables}

    def plain(text: str) -> tuple[str, float]:
        b = buckets(text)
        if not b:
            return "und", 0.0
        score = {
            x: math.log(1 / 4) + sum(
                n * math.log((c[k] + langid.ALPHA) / (sum(c.values()) + langid.ALPHA * langid.BUCKETS)) for k, n in b.items()
            ) for x,
            c in counts.items()
        }
        best = min(score, key=lambda x: (-score[x], x))
        return best, 1 / sum(math.exp(v - score[best]) for v in score.values())

    for at_once in (256, 1, 3):
        monkeypatch.setattr(langid, "LANGS_AT_ONCE", at_once)
        for r in langid.identify(docs, langid.fit(docs)).collect():
            lang, score = plain(rows[[x[0] for x in rows].index(r.doc_id)][1])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-3
    assert {100, 101} <= {r.doc_id for r in langid.identify(docs, langid.fit(docs)).where("lang_pred <> 'und'").collect()}


# ---- spans


@pytest.mark.parametrize(("query", "kinds", "plain"), [("secrets", secrets.BASE_KINDS, plain_secrets), ("pii", pii.BASE_KINDS, plain_persons)])
def test_digests_of_the_span_queries(spark, sf_dir, query, kinds, plain):  # noqa: ANN001
    run = secrets.op2_secrets if query == "secrets" else pii.op6_pii
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        base = plain(texts[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in spans if x[0] in kinds] == [[k, str(s), str(e)] for k, s, e in base]
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_every_candidate_is_scored(spark):  # noqa: ANN001
    texts = ["plain words here abcdef", "x qqqqq", "é " + "Zx9" * 300 + " token=abcdefgh tail99", "secret: aaaaaa,bbbbbbb"]
    some = secrets.Texts([t.encode() for t in texts])
    raw = "\n".join(texts).encode()
    got = [raw[s:e].decode() for s, e in zip(some.start, some.end)]
    assert got == ["abcdef", "Zx9" * 300, "tail99", "bbbbbbb"]
    model = secrets.SecretModel({"hex": secrets.infer([b"deadbeef01", b"0123abcdef", b"feedface77"] * 20), "word": secrets.infer([b"plainword", b"otherword"] * 20)})
    whole = model.advantages(some.raw, some.start, some.end)
    assert np.allclose(whole, [model.advantage(v.encode()) * len(v) for v in got])


# ---- quality


def test_each_group_has_a_determinant_no_larger_than_random_halves(spark):  # noqa: ANN001
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = quality.count_texts(docs).where("not base_failed")
    found = {r.g: r for r in quality.estimates(counted).collect()}
    key = quality._group_keys()[0]
    rows = counted.select(key.alias("g"), *(x.alias(f"x{i}") for i, x in enumerate(quality._statistics()))).toPandas()
    grid, floor = np.array(quality.GRID), np.diag(np.array(quality.FLOOR) ** 2)
    rng, tried = np.random.default_rng(3), 0
    for g, own in rows.groupby("g"):
        x = np.round(own[[f"x{i}" for i in range(4)]].to_numpy() / grid) * grid
        assert found[g].texts == len(x)
        if len(x) < 20:
            continue
        low = np.array([[found[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        scatter = lambda h: quality.CONSISTENT * np.cov(h.T, bias=True) + floor
        halves = [np.linalg.det(scatter(x[rng.permutation(len(x))[: math.ceil(quality.HALF * len(x))]])) for _ in range(200)]
        assert np.linalg.det(low @ low.T) <= min(halves) * 1.05, g
        tried += 1
    assert tried >= 4


def test_small_groups_lean_on_their_language(spark):  # noqa: ANN001
    big = [(i, f"c{i}", "en", "a", 100 + i % 7, 500 + 10 * (i % 9), i % 3, 0, 0) for i in range(300)]
    small = [(900 + i, f"x{i}", "en", "b", 100, 4000, 90, 30, 40) for i in range(5)] + [(990, "y", "en", "c", 101, 520, 1, 0, 0)]
    names = "doc_id long, key string, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    counted = spark.createDataFrame(big + small, names).withColumn("key", F.xxhash64("key")).withColumn("base_failed", F.lit(False))
    original = quality.count_texts
    try:
        quality.count_texts = lambda docs: docs
        kept = {r.doc_id for r in quality.judge(counted).where("kept").collect()}
    finally:
        quality.count_texts = original
    assert kept == {*range(300), 990}


# ---- archives


def test_no_damage_of_a_byte_raises():
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>")]
    odd = [
        warc.member(head, b"HTTP/1.1 200 OK\r\nno colon here\r\n\r\nbody"), warc.member([("WARC-Type", "revisit")], b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n"),
        warc.member([("WARC-Type", "revisit")], b""), warc.member([("WARC-Type", "warcinfo")], b"\xff\xfe"),
    ]
    kinds = [x.kind if isinstance(x, warc.Record) else x.reason for x in warc.read_archive(members(1)[0] + b"".join(odd) + members(2)[1])]
    assert kinds == ["response", "header line without a colon", "revisit", "warcinfo", "response"]  # two damaged ones in a row are one gap
    plain = b"".join(warc._inflate(memoryview(m), 0)[0] for m in (members(1)[0], odd[2], odd[3]))
    for whole in (members(2)[0] + odd[2] + members(2)[1], plain):
        for at in range(len(whole)):
            for flip in (0xFF, 0x01, 0x20):
                bad = bytearray(whole)
                bad[at] ^= flip
                for x in warc.read_archive(bytes(bad)):
                    warc._row("p", x, True)


def test_gaps_are_logged(spark, tmp_path, caplog):  # noqa: ANN001
    (tmp_path / "a.warc.gz").write_bytes(members(1)[0] + b"junk" * 9 + members(2)[1])
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")
    records = warc.read_archives(files, str(tmp_path))
    assert warc.log_gaps(records) == 1 and "36 bytes" in caplog.text and records.where("kind = 'response'").count() == 2

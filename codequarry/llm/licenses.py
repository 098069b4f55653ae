"""License scan: a positional index of licence words, looked up by each file's rarest ones.

Index. Templates (licence notices and the phrases that name a licence) are word sequences. The index holds a posting for each word of
each template: template and position. A word's weight is its inverse document frequency over all files, counted in a first pass, where
only words of templates are counted, so what the driver gets has the size of the templates.

Scan. Of each file, the RAREST different licence words with the highest weight are looked up, and beside them every word that is the rarest of a
mandatory phrase, so no phrase can be missed. Each place of such a word and each of its postings give a start at which the template would
have to stand; starts that several postings of different words agree on (all of them where a template is a phrase) are candidates. A candidate is
verified: its mandatory phrases must stand, word by word, where the start puts them (SLACK words to either side for notices, which people edit),
and the words that stand where the template has them must hold SHARE of the template's weight.

score is the largest share of the templates found; a phrase that stands counts whole. Phrases count every place, notices the best start
among those that overlap.

Defined results: null and empty text has 0 words, no label and score 0; ties in weight go to the word that sorts first; repeated rows are scanned alike;
an empty table gives no rows; other columns are ignored. Very long texts are scanned in stretches of words, so memory is bounded by
a text and not by its number of candidates.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import portions, table, texts_of, type_of, word_hashes

#: Different licence words that are looked up in a file besides those of phrases, words of slack, least share of weight, agreeing words.
RAREST, SLACK, SHARE, AGREE = 12, 8, 0.6, 3
#: Bytes scanned at once, and words of a stretch.
AT_ONCE, STRETCH = 8 << 20, 1 << 16

_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Phrases that the contract names, with their labels, then further phrases.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
PHRASES = (
    ("cc by", "cc"), ("creative commons attribution", "cc"), ("bsd license", "bsd"), ("isc license", "isc"), ("mozilla public license", "mpl"),
    ("lesser general public license", "lgpl"), ("affero general public license", "agpl"), ("eclipse public license", "epl"),
)
#: Label, notice, and the phrases that a file with that notice must have.
NOTICES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""", ("permission is hereby granted free of charge", "included in all copies or substantial portions")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.""", ("redistribution and use in source and binary forms",)),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""", ("licensed under the apache license",)),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ("redistribute it and or modify it under the terms of the gnu general public license",)),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("subject to the terms of the mozilla public license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("licensed under the gnu general public license",)),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("licensed under the apache license",)),
    ("mit", "Released under the MIT License.", ("under the mit license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
)

MATCHES = "array<struct<label:string,kind:string,start:long,length:int,score:double>>"
MATCH_TYPE = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("score", pa.float64())]))


def words_of(text: str) -> list[str]:
    """Words of a template, as the contract cuts those of a file."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _hash(word: str) -> int:
    return int(word_hashes(np.frombuffer(word.encode(), dtype=np.uint8), True, _GAPS)[0][0])


class Vocabulary:
    """The different words of templates, numbered in the order of their hashes."""

    def __init__(self, words: set[str]):
        pairs = sorted((_hash(w), w) for w in words)
        self.hashes, self.words = np.array([h for h, _ in pairs], dtype=np.uint64), [w for _, w in pairs]
        self.number = {w: i for i, w in enumerate(self.words)}
        # a table over the hashes' first bits tells most other words at one look
        self.first = np.zeros(1 << 16, dtype=bool)
        self.first[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that hold a licence word, and its number."""
        at = np.flatnonzero(self.first[(hashes >> np.uint64(48)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[found] == hashes[at]
        return at[same], found[same]


class Scanned:
    """Words of some texts: which are licence words, and how many words stand before each text."""

    def __init__(self, raws: list[bytes], vocabulary: Vocabulary):
        hashes, starts, _ = word_hashes(np.frombuffer(b"\0".join(raws), dtype=np.uint8), True, _GAPS)
        begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
        self.before = np.searchsorted(starts, begins)
        self.at, self.number = vocabulary.numbers(hashes)
        self.cut = np.searchsorted(self.at, self.before)

    def text(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the licence words of text i."""
        a, b = self.cut[i], self.cut[i + 1]
        return self.at[a:b] - self.before[i], self.number[a:b]


class Template:
    def __init__(self, label: str, kind: str, words: np.ndarray, weights: np.ndarray, needed: list[np.ndarray]):
        """needed: word numbers of the mandatory phrases. A phrase needs all of itself at its start; phrases of notices may stand anywhere near."""
        self.label, self.kind, self.words, self.needed = label, kind, words, needed
        self.weights = weights[words] / max(1e-12, float(weights[words].sum()))
        self.agree = len(set(words.tolist())) if kind == "phrase" else AGREE
        #: Where each mandatory phrase may stand in the template.
        self.offsets = [[i for i in range(len(words) - len(p) + 1) if (words[i : i + len(p)] == p).all()] for p in needed]


class LicenseIndex:
    """Postings (template, position) of every licence word, and the words' weights."""

    def __init__(self, vocabulary: Vocabulary, frequency: np.ndarray, n_files: int, phrases: tuple, notices: tuple):
        self.vocabulary = vocabulary
        self.weights = np.log((n_files + 1) / (frequency + 1)) + 1e-6
        number = lambda text: np.array([vocabulary.number[w] for w in words_of(text)], dtype=np.int64)
        self.templates = [Template(label, "phrase", number(text), self.weights, [number(text)]) for text, label in phrases]
        self.templates += [Template(label, "notice", number(text), self.weights, [number(p) for p in needed]) for label, text, needed in notices]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(self.templates):
            for at, w in enumerate(template.words.tolist()):
                self.postings[w].append((t, at))
        #: From most to least weight; the place of each word in that order.
        order = sorted(range(len(self.weights)), key=lambda w: (-self.weights[w], vocabulary.words[w]))
        self.rank = np.argsort(np.array(order))
        self.longest = max(len(t.words) for t in self.templates)
        #: The rarest word of each phrase, also of mandatory ones, is always looked up.
        self.always = np.zeros(len(order), dtype=bool)
        for template in self.templates:
            for p in template.needed:
                self.always[p[self.rank[p].argmin()]] = True

    def starts(self, at: np.ndarray, number: np.ndarray, looked_up: np.ndarray) -> list[tuple[int, int]]:
        """Templates and starts that enough postings of the words looked up agree on."""
        votes: dict[int, list[np.ndarray]] = defaultdict(list)
        for w in np.unique(number[looked_up[number]]).tolist():
            places = at[number == w]
            for t, offset in self.postings[w]:
                votes[t].append(np.stack((places - offset, np.full(len(places), w))))
        out = []
        for t, parts in votes.items():
            template = self.templates[t]
            some = np.unique(np.concatenate(parts, axis=1), axis=1)  # a word counts once a start
            start, n = np.unique(some[0], return_counts=True)
            enough = start[n >= min(template.agree, int(looked_up[np.unique(template.words)].sum()))]
            out += [(t, s) for s in enough.tolist()]
        return out

    def verified(self, at: np.ndarray, number: np.ndarray, candidates: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
        """Template, start and share of the candidates whose mandatory phrases stand and whose share is enough."""
        found = []

        def words(begin: int, end: int) -> np.ndarray:
            out = np.full(end - begin, -1, dtype=np.int64)
            a, b = np.searchsorted(at, (begin, end))
            out[at[a:b] - begin] = number[a:b]
            return out

        for t, start in candidates:
            template = self.templates[t]
            size = len(template.words)
            if template.kind == "phrase":
                if start >= 0 and (words(start, start + size) == template.words).all():
                    found.append((t, start, 1.0))
                continue
            near = words(start - SLACK, start + size + SLACK)
            stand = np.zeros(size, dtype=bool)
            for s in range(2 * SLACK + 1):
                stand |= near[s : s + size] == template.words
            share = float(template.weights[stand].sum())
            if share < SHARE:
                continue
            whole = all(any((near[i : i + len(p)] == p).all() for o in offsets for i in range(o, o + 2 * SLACK + 1)) for p, offsets in zip(template.needed, template.offsets, strict=True))
            if whole:
                found.append((t, max(start, 0), share))
        return found

    def matches(self, at: np.ndarray, number: np.ndarray) -> list[dict]:
        """What stands in a text whose licence words are `number` at the positions `at`, by start, then label."""
        if not len(at) or not self.always[number].any():
            return []  # without any of them no mandatory phrase stands
        own = np.unique(number)
        looked_up = self.always.copy()
        looked_up[own[np.argsort(self.rank[own])][:RAREST]] = True
        found: set[tuple[int, int, float]] = set()
        reach = self.longest + SLACK
        # a stretch has every template that begins in it, and so some that begin in its neighbours
        for begin in range(0, int(at[-1]) + 1, STRETCH):
            a, b = np.searchsorted(at, (begin - reach, begin + STRETCH + reach))
            if a < b and self.always[number[a:b]].any():
                found.update(self.verified(at[a:b], number[a:b], self.starts(at[a:b], number[a:b], looked_up)))
        best: list[tuple[int, int, float]] = []
        last: dict[int, list[int]] = defaultdict(list)  # of a notice, one start among those that overlap
        for t, start, share in sorted(found, key=lambda f: (-f[2], f[1], f[0])):
            size = len(self.templates[t].words)
            if self.templates[t].kind == "notice" and any(abs(start - s) < size for s in last[t]):
                continue
            last[t].append(start)
            best.append((t, start, share))
        rows = [(start, self.templates[t].label, self.templates[t].kind, len(self.templates[t].words), share) for t, start, share in best]
        return [{"label": x, "kind": k, "start": s, "length": n, "score": v} for s, x, k, n, v in sorted(rows)]


def build_index(docs: DataFrame, phrases: tuple = (*BASE_PHRASES, *PHRASES), notices: tuple = NOTICES) -> LicenseIndex:
    """The index of phrases (text, label) and notices (label, text, mandatory phrases), weighed by the files of docs(text)."""
    vocabulary = Vocabulary({w for text, _ in phrases for w in words_of(text)} | {w for _, text, needed in notices for t in (text, *needed) for w in words_of(t)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, files = np.zeros(len(vocabulary.words), dtype=np.int64), 0
        for batch in batches:
            raws = texts_of(batch)
            files += len(raws)
            for a, b in portions(raws, AT_ONCE):
                some = Scanned(raws[a:b], vocabulary)
                text = np.searchsorted(some.cut, np.arange(len(some.at)), side="right")
                n += np.bincount(np.unique(text * len(n) + some.number) % len(n), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(n))]), pa.array([files, *n.tolist()])], ["word", "files"])

    rows = docs.select("text").mapInArrow(count, "word long, files long").groupBy("word").agg(F.sum("files").alias("files")).collect()
    counts = {r.word: r.files for r in rows}
    frequency = np.array([counts.get(i, 0) for i in range(len(vocabulary.words))])
    return LicenseIndex(vocabulary, frequency, counts.get(-1, 0), phrases, notices)


def find_licenses(docs: DataFrame, index: LicenseIndex) -> DataFrame:
    """doc_id, n_words, matches(label, kind, start, length, score) for each row of docs(doc_id, text); starts count words from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # as large as the templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            raws = texts_of(batch)
            counts, found = [], []
            for a, b in portions(raws, AT_ONCE):
                some = Scanned(raws[a:b], known.vocabulary)
                counts += np.diff(some.before).tolist()
                found += [known.matches(*some.text(i)) for i in range(b - a)]
            made = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, MATCH_TYPE)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "matches"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {type_of(docs, 'doc_id')}, n_words long, matches {MATCHES}")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places are those of the three phrases; a phrase's label and length tell it apart from the others."""
    docs = table(spark, sf_dir, "documents")
    found = find_licenses(docs, build_index(docs))
    kinds = [f"(x.kind = 'phrase' AND x.label = '{label}' AND x.length = {len(words_of(text))})" for text, label in BASE_PHRASES]
    base = F.expr(f"filter(matches, x -> {' OR '.join(kinds)})")
    rows = found.select("doc_id", "n_words", "matches", base.alias("base"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        labels("base").alias("base_labels"), labels("matches").alias("labels"), F.coalesce(F.array_max("matches.score"), F.lit(0.0)).alias("score"),
    )

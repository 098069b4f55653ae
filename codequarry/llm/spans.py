"""Spans in texts: byte scanning helpers and the digest columns that the span queries share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How operators return what they found in a text: code points, end exclusive.
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def to_code_points(raw: bytes, spans: list[tuple]) -> list[tuple]:
    """(kind, start, end, score) with byte offsets, as code point offsets."""
    if not spans or raw.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return [(k, int(before[s]), int(before[e]), *rest) for k, s, e, *rest in spans]


def ordered(spans: list[tuple], kinds: tuple[str, ...]) -> list[dict]:
    rank = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in sorted(spans, key=lambda v: (v[1], rank[v[0]], v[2]))]


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, (kind,))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

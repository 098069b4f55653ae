"""WARC archives: a writer that turns equal payloads into revisits, and a salvage reader.

Each page becomes a record in a gzip member of its own. Of pages with equal payloads the one with the
smallest id is written as a response; the others become revisit records that refer to it and carry
its HTTP header, so that payload length and digest survive without the payload.

The reader checks every member (magic, deflate stream, CRC and length) and every record (version line,
header syntax, Content-Length, end mark, payload digest). After a failed check it searches for the next
gzip magic or version line from which a record passes all checks, goes on from there, and reports the bytes in
between as a gap with the reason of the failure. Plain and gzipped archives, several records in a member, and
truncated ends are read. Of a member of several records that fails, those before the damage are kept: of a truncated one all
that pass the checks of records; after a wrong CRC or deflate error only responses whose payload digest agrees, as
nothing else vouches for their bytes.

Archives go to a shared folder by pyarrow's file systems, in files of FILE_BYTES about, under names that hold the
task attempt; only files that a finished task reports are read, so a lost executor leaves no wrong record.

Defined results: null html is an empty payload; rows of one page id and payload are all responses if that id
is the smallest; a null id counts after all others; a null url is written as an empty target; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import durable, own_folder, remove_folder, table

FILE_BYTES = 16 << 20
#: Payloads of fewer bytes are always written in full.
REVISIT_MIN_BYTES = 0
LEVEL = 1
CHUNK = 1 << 16

# Marks of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(?:0\.1[678]|1\.[01])\r?\n")
END = b"\r\n\r\n"
LENGTH = re.compile(r"[0-9]{1,18}")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self, strict: bool = False) -> tuple[dict[str, str], bytes]:
        """HTTP headers and payload of the block. Header lines without a colon are passed over, or with strict raise Damaged."""
        head, _, payload = self.block.partition(END)
        lines = head.split(b"\r\n")[1:]
        return _fields(lines if strict else [x for x in lines if b":" in x]), payload

    def payload_bytes(self) -> int | None:
        """Length of the payload: a response's own, a revisit's as its HTTP header states it, if it does."""
        if self.kind not in ("response", "revisit"):
            return len(self.block)
        http, payload = self.http()
        if self.kind == "response":
            return len(payload)
        stated = http.get("content-length")
        return int(stated) if stated and LENGTH.fullmatch(stated) else None

    def check(self) -> None:
        """Raise Damaged unless a response's stated payload digest agrees, or, where nothing vouches for the block, its HTTP header is in order."""
        if self.kind == "response":
            stated = self.headers.get("warc-payload-digest", "")
            if not stated.startswith("sha1:"):
                self.http(strict=True)
            elif base32_sha1(self.http()[1]) != stated[5:]:
                raise Damaged("payload digest differs")
        elif self.kind == "revisit":
            stated = self.http(strict=True)[0].get("content-length", "0")
            if not LENGTH.fullmatch(stated):
                raise Damaged("revisit without a valid length")


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(Exception):
    """A check failed; the text says which."""


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        if not line:
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record whose version line is at `at`, and where it ends; raises Damaged."""
    if not (m := VERSION.match(data, at)):
        raise Damaged("no version line")
    head_end = data.find(END, m.end() - 2)
    if head_end < 0:
        raise Damaged("header without an end")
    headers = _fields(data[m.end() : head_end].split(b"\r\n"))
    stated = headers.get("content-length", "")
    if not LENGTH.fullmatch(stated):
        raise Damaged("no valid Content-Length")
    length, start = int(stated), head_end + len(END)
    if start + length > len(data):
        raise Damaged("truncated block")
    end = start + length
    if data[end : end + 4] != END:
        raise Damaged("no end mark after the block")
    record = Record(at, end + 4 - at, headers, data[start:end])
    record.check()
    return record, end + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at `at`, checked, and where it ends; raises Damaged. Input is fed in chunks, so a member costs its own length."""
    if bytes(data[at : at + 3]) != MAGIC:
        raise Damaged("no gzip member")
    engine, out, pos = zlib.decompressobj(31), [], at
    try:
        while not engine.eof:
            if pos >= len(data):
                raise Damaged("truncated member")
            piece = data[pos : pos + CHUNK]
            out.append(engine.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Damaged(f"gzip: {str(e)[:60]}") from None
    return b"".join(out), pos - len(engine.unused_data)


def _inflate_all(data: memoryview) -> bytes:
    """What a damaged gzip member gives before its failure: a step that fails is retried with less input, down to a byte."""
    engine, out, size, pos = zlib.decompressobj(31), [], CHUNK, 0
    while pos < len(data) and not engine.eof:
        saved = engine.copy()
        try:
            out.append(engine.decompress(data[pos : pos + size]))
            pos += size
        except zlib.error:
            if size == 1:
                break
            engine, size = saved, size // 16
    return b"".join(out)


def _consumed(data: memoryview, size: int) -> int:
    """Fewest bytes of the gzip member that give its first `size` bytes."""
    engine, got, step, pos = zlib.decompressobj(31), 0, CHUNK, 0
    while got < size:
        saved = engine.copy()
        try:
            n = len(engine.decompress(data[pos : pos + step]))
        except zlib.error:
            n = size
        if step > 1 and got + n >= size:
            engine, step = saved, step // 16
            continue
        got, pos = got + n, pos + step
    return pos


def _salvaged(data: memoryview, at: int, truncated: bool) -> tuple[list[Record | Gap], int]:
    """Records of a failed member that holds several, with gaps between them, and where the last one ends. A member that gives one
    record and no byte more is given up as a whole."""
    inflated = _inflate_all(data[at:])
    if not VERSION.match(inflated):
        return [], at
    found, begin = [], 0
    vouched = lambda r: r.kind == "response" and r.headers.get("warc-payload-digest", "").startswith("sha1:")
    places = [(x, x.offset + x.length) for x in _plain(inflated, 0, None) if isinstance(x, Record) and (truncated or vouched(x))]
    if not places or (places[0][1] >= len(inflated) and len(places) == 1):
        return [], at
    span = _consumed(data[at:], places[-1][1])
    for x, end in places:
        if x.offset > begin:
            found.append(Gap(at, span, "damaged part of a member"))
        x.offset, x.length, begin = at, span, end
        found.append(x)
    return found, at + span


def _plain(data: bytes, base: int, span: int | None) -> Iterator[Record | Gap]:
    """Records of uncompressed bytes. Within a gzip member (span given) all lie at the member's offset and length."""
    at = 0
    while at < len(data):
        try:
            record, end = parse_record(data, at)
        except Damaged as e:
            begin, reason, found = at, str(e), None
            for m in VERSION.finditer(data, at + 1):
                try:
                    found = parse_record(data, m.start())
                    break
                except Damaged:
                    continue
            at = found[0].offset if found else len(data)
            yield Gap(base if span else base + begin, span or at - begin, reason)
            continue
        record.offset, record.length = (base, span) if span else (base + at, end - at)
        yield record
        at = end


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Every record that passes all checks, in order, and the gaps between them."""
    if MAGIC not in data:
        yield from _plain(data, 0, None)
        return
    view, at, since, reason = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            if VERSION.match(data, at):
                record, end = parse_record(data, at)
                found: list[Record | Gap] = [record]
            else:
                inflated, end = _inflate(view, at)
                found = list(_plain(inflated, at, end - at))
                if not any(isinstance(x, Record) for x in found):
                    raise Damaged(found[0].reason if found else "empty member")
        except Damaged as e:
            kept, end = _salvaged(view, at, str(e) == "truncated member") if bytes(view[at : at + 3]) == MAGIC else ([], at)
            if kept:
                if since is not None:
                    yield Gap(since, at - since, reason)
                yield from kept
                since, reason, at = end, str(e), end - 1
            elif since is None:
                since, reason = at, str(e)
            nexts = [x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/", at + 1)) if x >= 0]
            at = min(nexts, default=len(data))
            continue
        if since is not None:
            yield Gap(since, at - since, reason)
            since = None
        yield from found
        at = end
    if since is not None:
        yield Gap(since, len(data) - since, reason)


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (*headers, ("Content-Length", str(len(block))))) + "\r\n"
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(head.encode() + block + END) + engine.flush()


def _page(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _page(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or ""))
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _page(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    return member(headers, http if revisit else http + payload)


def with_revisits(pages: DataFrame, least: int = REVISIT_MIN_BYTES) -> DataFrame:
    """pages(page_id, url, html) with sha1 (hex, of the payload's UTF-8) and refers_to (null for responses). Only payloads that
    occur more than once enter the join; rows of a very frequent one are split by the adaptive planner."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    long_enough = F.octet_length("html") >= least
    first = rows.where(long_enough).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(other, F.col("first")).alias("refers_to"))


def _store(folder: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages as archives into folder (a URI that pyarrow opens). Returns path, records, bytes of each finished file, materialised."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            ids, urls, payloads, hashes, firsts = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to"))
            for page_id, url, html, sha1, refers_to in zip(ids, urls, payloads, hashes, firsts):
                data = page_member(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, date)
                if out is None:
                    path = f"{root}/pages-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, records, size = store.open_output_stream(path, compression=None), 0, 0
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "records", "bytes"), d)) for d in done],
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        )

    return durable(with_revisits(pages).mapInArrow(write, "path string, records long, bytes long"))


ROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string()),
])
ROW_TYPES = (
    "path string, offset long, length long, kind string, record_id string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"
)
#: Rows and bytes of payload that the reader hands over at once.
ROWS_AT_ONCE, PAYLOAD_AT_ONCE = 2000, 1 << 24


def _row(path: str, x: Record | Gap, payloads: bool) -> dict:
    if isinstance(x, Gap):
        return {"path": path, "offset": x.offset, "length": x.length, "kind": "gap", "reason": x.reason}
    h = x.headers
    payload = x.http()[1] if x.kind in ("response", "revisit") else x.block
    return {
        "path": path, "offset": x.offset, "length": x.length, "kind": x.kind, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"),
        "refers_to": h.get("warc-refers-to"), "payload_bytes": x.payload_bytes(), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload": payload if payloads else None,
    }


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives files(path), and one of kind `gap` with a reason for each stretch of bytes that was given up."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(folder)[0]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for x in read_archive(data):
                    rows.append(_row(path, x, payloads))
                    size += len(rows[-1].get("payload") or b"")
                    if len(rows) >= ROWS_AT_ONCE or size >= PAYLOAD_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema=ROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ROW)

    parts = max(1, min(4096, files.count()))
    return files.select("path").repartition(parts).mapInArrow(read, ROW_TYPES)


def log_gaps(records: DataFrame, most: int = 100) -> int:
    """Log what read_archives() gave up, the first `most` stretches one by one, and return how many there are."""
    gaps = records.where("kind = 'gap'")
    n = gaps.count()
    if n:
        total = gaps.agg(F.sum("length")).first()[0]
        logging.warning("%d stretches of damaged archives given up, %d bytes", n, total)
        for r in gaps.orderBy("path", "offset").limit(most).collect():
            logging.warning("%s: %d bytes at %d given up: %s", r.path, r.length, r.offset, r.reason)
    return n


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    records = durable(read_archives(files, folder, payloads=False).drop("payload"))
    log_gaps(records)
    remove_folder(spark, folder)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    pages = records.where(F.col("kind").isin("response", "revisit"))
    return pages.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        number("refers_to").alias("refers_to")
    )


#: The round trip's result from the table itself; a base-32 digit takes 5 bits, so 5 hex digits make 4 of them.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, upper(sha1(h)) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, (5 * i + 1)::INTEGER, 5))::BIGINT) AS v FROM s)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (q // 32768 + 1)::INTEGER, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (q // 1024 % 32 + 1)::INTEGER, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (q // 32 % 32 + 1)::INTEGER, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (q % 32 + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

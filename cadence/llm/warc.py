"""WARC archives: written with segments and chunked framing, read by reassembling segments.

Writing: rows with equal payloads are found by digest; the one with the largest id is a `response`, the others are
`revisit` records that refer to it. A record whose block is longer than `segment_bytes` is split: the first segment
stands in the record, the rest in `continuation` records that name it by WARC-Segment-Origin-ID, and the last of them
has the total length. Bodies over `chunk_bytes` use chunked transfer framing.

Reading: each archive is parsed as a stream in a task; segments are grouped by origin (one record's segments, as long
as its payload), ordered by number, checked against the total length and joined; then HTTP framing is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.common import Published, open_store
from cadence.session import written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated payloads (28 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
_RECORD = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, complete boolean, payload binary"
_PIECE = f"origin string, number long, total long, headers string, block binary, alone struct<{_RECORD.replace(' ', ':').replace(',:', ',')}>"
_BATCH_BYTES = 8_000_000
#: First bytes of a gzip member; bytes decompressed at a time, and searched at a time after damage.
_MAGIC, _FEED, _WINDOW = b"\x1f\x8b\x08", 8192, 1 << 20


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _chunked(body: bytes, size: int) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def _dechunked(body: bytes) -> bytes:
    """The body without chunked framing; ValueError if a chunk is cut short or its size is no number."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        n = int(body[at:eol].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if n < 0 or body[eol + 2 + n : eol + 4 + n] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[eol + 2 : eol + 2 + n])
        at = eol + 2 + n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def page_records(page_id, url, payload: bytes, digest: str, refers_to, unique: str, date: str, segment_bytes: int, chunk_bytes: int):
    """The WARC records, as gzip members, of one page."""
    name = "" if page_id is None else page_id
    record_id = f"<urn:x-page:{name}#{unique}>"
    common = [("WARC-Date", date)]
    if url is not None:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        common.append(("WARC-Target-URI", uri))
    typed = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common, *typed]
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
        yield _record(headers, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    if len(payload) > chunk_bytes:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk_bytes)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common, *typed]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-page:{name}#{unique}-{n}>"), *common]
        headers += [("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n)]
        if n == len(parts):
            headers.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(headers, part)


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    segment_bytes: int = 4096,
    chunk_bytes: int = 2048,
    date: str = "2024-01-01T00:00:00Z",
) -> list[str]:
    """Write a record per row to gzip archives in `folder` (a URI shared by all), one a partition; returns their paths.

    Null html is an empty payload, and all empty payloads are equal. Of rows with equal payloads and the same largest
    id (repeated rows) each is a response. A null id is smaller than any other. A null url gives no target URI.
    Further columns are not read. An empty table gives no archive.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.unhex(F.sha1("payload")))
    same = rows.groupBy("sha1").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").select("sha1", "last")
    same = written(same, "same")
    # beyond the bound, adaptive execution splits a payload that many rows have
    same = F.broadcast(same) if same.count() <= BROADCAST_ROWS else same
    rows = rows.join(same, "sha1", "left").select(
        "id", "url", "payload", "sha1", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, n = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    path = f"{folder}/archive-{part:05d}.warc.gz"
                    out = Published(path)
                digest = base64.b32encode(sha1).decode()
                for data in page_records(page_id, url, payload, digest, refers_to, f"{part}-{n}", date, segment_bytes, chunk_bytes):
                    out.write(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(r.path for r in rows.mapInArrow(write, "path string").collect())


class _Window:
    """Ranges of a file, read from its store a window at a time."""

    def __init__(self, file):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.data):
            self.start, self.data = at, self.file.read_at(max(n, _WINDOW), at) if at < self.size else b""
        return self.data[at - self.start : at - self.start + n]


class _Member:
    """One gzip member from `start` on, as bytes to take from the front and to push back.

    Damage ends it early, after all that could still be decompressed; `end` is where the next member starts, None if
    that can't be told.
    """

    def __init__(self, file, start: int):
        self.file, self.start, self.at, self.end = file, start, start, None
        self.inflate, self.data, self.done = zlib.decompressobj(31), bytearray(), False

    def _fill(self) -> bool:
        """More bytes, if there are any."""
        while not self.done:
            part = self.file.read_at(_FEED, self.at)
            try:
                out = self.inflate.decompress(part)
            except zlib.error:
                self.data += self._last(part)
                self.done = True
                return True
            self.at += len(part)
            if self.inflate.eof:
                self.done, self.end = True, self.at - len(self.inflate.unused_data)
            elif not part:
                self.done = True
            self.data += out
            if out:
                return True
        return False

    def _last(self, part: bytes) -> bytes:
        """What a part that can't be decompressed as a whole still gives, byte by byte."""
        again, at = zlib.decompressobj(31), self.start
        while at < self.at:
            before = self.file.read_at(min(_FEED, self.at - at), at)
            again.decompress(before)
            at += len(before)
        out = bytearray()
        try:
            for i in range(len(part)):
                out += again.decompress(part[i : i + 1])
        except zlib.error:
            pass
        return bytes(out)

    def line(self) -> bytes:
        """Up to a line feed, itself included; at most _FEED bytes and a part; empty at the end."""
        while (k := self.data.find(b"\n")) < 0 and len(self.data) < _FEED and self._fill():
            pass
        return self.take(k + 1 if k >= 0 else len(self.data))

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.data) < n and self._fill():
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def push(self, data: bytes) -> None:
        self.data[:0] = data


def _records(member: _Member):
    """(headers, block) of a member's records. A block that is cut short, has no length or a wrong one is None, and what
    follows is searched for the next record's first line."""
    found = False
    while line := member.line():
        if not re.match(rb"WARC/\d+\.\d+\r?\n", line):
            continue
        found, headers = True, {}
        while (line := member.line().rstrip(b"\r\n")) != b"":
            key, _, value = line.partition(b":")
            headers[key.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        size = headers.get("content-length", "")
        block = member.take(int(size)) if size.isdigit() else b""
        after = member.take(4)
        good = size.isdigit() and len(block) == int(size) and after in (b"\r\n\r\n", b"")
        if not good:
            member.push(block + after)
        yield headers, block if good else None
    if member.end is None and not found:
        yield {}, None


def _stream(path: str):
    """(headers, block) of each record of an archive of gzip members; the block is None if the record is damaged.

    After a damaged member reading goes on with the next one that holds a record; a member without a readable record
    gives one without headers.
    """
    store, name = open_store(path)
    with store.open_input_file(name) as opened:
        file, start = _Window(opened), 0
        size = file.size
        while start < size:
            member = _Member(file, start)
            yield from _records(member)
            start = member.end if member.end is not None else _next_member(file, start + 1, size)


def _next_member(file, start: int, size: int) -> int:
    """Where, from `start` on, a gzip member begins that decompresses to a record; the archive's size if none does."""
    while start < size:
        window = file.read_at(_WINDOW + len(_MAGIC) - 1, start)
        at = window.find(_MAGIC)
        while at >= 0:
            try:
                if zlib.decompressobj(31).decompress(file.read_at(_FEED, start + at), 5) == b"WARC/":
                    return start + at
            except zlib.error:
                pass
            at = window.find(_MAGIC, at + 1)
        start += _WINDOW
    return size


def _page(uri: str | None) -> int | None:
    m = re.match(r"<urn:x-page:(-?\d+)", uri or "")
    return int(m[1]) if m else None


def _decoded(headers: dict, block: bytes | None, complete: bool) -> dict:
    """A record's row. `complete` is false for a block that is damaged or can't be decoded."""
    row = {"page_id": _page(headers.get("warc-record-id")), "record_type": headers.get("warc-type"), "refers_to": _page(headers.get("warc-refers-to"))}
    broken = row | {"payload_digest": None, "payload_bytes": None, "complete": False, "payload": None}
    if block is None or not complete:
        return broken
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        if headers["warc-type"] == "revisit":
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            return row | {"payload_digest": digest, "payload_bytes": int(http[b"content-length"]), "complete": True, "payload": None}
        if http.get(b"transfer-encoding") == b"chunked":
            body = _dechunked(body)
        digest = payload_digest(body)
        ok = headers.get("warc-payload-digest", f"sha1:{digest}") == f"sha1:{digest}" and int(http.get(b"content-length", len(body))) == len(body)
    except (ValueError, KeyError):
        return broken
    return row | {"payload_digest": digest, "payload_bytes": len(body), "complete": ok, "payload": body}


def _batches(rows, schema: pa.Schema, weight):
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += weight(row) + 200
        if size > _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def read_warc(spark: SparkSession, paths: list[str], with_payload: bool = False) -> DataFrame:
    """Pages of archives: page_id, record_type, refers_to, payload_digest, payload_bytes, complete (and payload).

    complete is false if segments are missing or repeated, don't add up to the total length, if the payload doesn't fit
    its digest or length, or if a record has no length or a wrong one, is cut short or has broken framing; its digest
    and length are null where they can't be told. Reading goes on after damage; a damaged record that doesn't tell its
    page and type any more has nulls for them (neighbours without a readable start are one row). Revisits have the digest and length that their headers give, and no
    payload. Segments whose first one is missing name no page and give no row. Each archive is read once.
    """
    import json

    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
              ("payload_bytes", pa.int64()), ("complete", pa.bool_()), ("payload", pa.binary())]
    record_schema = pa.schema(fields)
    piece_schema = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("headers", pa.string()), ("block", pa.binary()), ("alone", pa.struct(fields))])

    def slim(row: dict) -> dict:
        return row if with_payload else row | {"payload": None}

    def number(headers: dict, name: str) -> int | None:
        return int(headers[name]) if headers.get(name, "").isdigit() else None

    def piece(place: str, h: dict, block: bytes | None) -> dict | None:
        """A whole record, decoded, under its place in the archives, or a segment under the id of its first one."""
        record = h.get("warc-record-id", place)
        n = number(h, "warc-segment-number")
        if n is None:
            kept = h.get("warc-type", "response" if block is None else None) in ("response", "revisit")
            return {"origin": place, "alone": slim(_decoded(h, block, True))} if kept else None
        first = "warc-segment-origin-id" not in h
        return {"origin": record if first else h["warc-segment-origin-id"], "number": n, "total": number(h, "warc-segment-total-length"),
                "headers": json.dumps(h) if first else None, "block": block}

    def pieces(batches):
        rows = (p for batch in batches for k in batch.column(0).to_pylist() for i, (h, b) in enumerate(_stream(paths[k])) if (p := piece(f"{k}:{i}", h, b)))
        yield from _batches(rows, piece_schema, lambda r: len(r.get("block") or b"") + len((r.get("alone") or {}).get("payload") or b""))

    def reassembled(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    headers, total, parts, alone = (c[i].as_py() for c in batch.columns)
                    yield from alone
                    if headers is None:
                        continue
                    whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and all(p["block"] is not None for p in parts)
                    block = b"".join(p["block"] for p in parts) if whole else None
                    yield slim(_decoded(json.loads(headers), block, whole and total == len(block)))

        yield from _batches(rows(), record_schema, lambda r: len(r["payload"] or b""))

    files = spark.range(0, len(paths), 1, max(1, len(paths)))
    grouped = (
        files.mapInArrow(pieces, _PIECE)
        .groupBy("origin")
        .agg(
            F.max("headers").alias("headers"), F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "block")))).alias("parts"),
            F.collect_list("alone").alias("alone"),
        )
        .select("headers", "total", "parts", "alone")
    )
    out = grouped.mapInArrow(reassembled, _RECORD)
    return out if with_payload else out.drop("payload")

"""WARC archives: writing with revisits and segments, and reading with segment reassembly.

Writing: a payload goes into an HTTP response with chunked transfer framing.
Of equal payloads of at least ``REVISIT_BYTES`` the row with the largest id is
the response, and the others are ``revisit`` records that refer to its record id
and keep the HTTP header with the payload's length.  Such a response is named by
its id and its payload's digest, so that a revisit knows the name.  A block of
more than ``SEGMENT_BYTES`` is cut into a first record and ``continuation``
records.  Every record is a gzip member of its own.  Records are gathered into
rows of about ``BLOCK_BYTES``, which Spark's text writer puts into files of at
most ``FILE_BLOCKS`` rows: the zero byte that ends a member of less than 16 MB is
its line separator, so a file is nothing but members.

Reading: files are parsed once, record by record by their Content-Length, to a
written table.  Records without segments are finished on the spot.  The parts of
segmented ones are grouped by the origin's identifier, ordered by segment
number, checked for gaps and against the total length, and joined; then the
chunked framing is decoded.  Every revisit must find a response of the record id
that it refers to, with its digest and length.

Payloads count as equal by SHA-256 and length.  Defined results: a null payload
is empty and a null url leaves its header out; rows that repeat the largest id
of equal payloads are all responses, under one record id, as they are one
resource; a null id is smaller than any other; a payload of any length is
written whole, in segments; ids that are no whole numbers raise ``TypeError``; a
broken archive raises ``ValueError``; an empty table gives an empty archive; only
the three columns named are read, whatever others there are.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm.common import stored

REVISIT_BYTES = 1_000
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
BLOCK_BYTES, FILE_BLOCKS = 4_000_000, 16
#: The largest segment, which keeps a member below 16 MB; and the level of compression.
MOST_SEGMENT, LEVEL = 8_000_000, 4
CRLF = b"\r\n"
_DATE = "2020-01-01T00:00:00Z"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMED = f"{RECORDS}, name string, target string"
#: What a parsed file gives: finished records, or parts of segmented ones.
_PARSED = f"{_NAMED}, origin string, number int, total long, head string, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size := data[at:end].split(b";")[0].strip()):
            raise ValueError("broken chunk header")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        at = end + 2
        out.append(data[at : at + n])
        if len(out[-1]) < n or data[at + n : at + n + 2] != CRLF:
            raise ValueError("broken chunk")
        at += n + 2


def _header(fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _uri(url: str | None) -> str | None:
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _name(page_id: int | None, own: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{own}>"


def records(page_id: int | None, uid: str, url: str | None, payload: bytes, refers_to: tuple[int | None] | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page, each with the CR LF CR LF after it."""
    digest = sha1(payload).digest()
    named = refers_to is None and len(payload) >= REVISIT_BYTES
    name = _name(page_id, digest.hex() if named else uid)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _uri(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode())]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        target = ("WARC-Refers-To", _name(refers_to[0], digest.hex()))
        head = _header([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, profile, target], len(block))
        return [head + block + CRLF * 2]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
    if len(block) <= segment:
        return [_header(kind, len(block)) + block + CRLF * 2]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [_header([*kind, ("WARC-Segment-Number", "1")], len(parts[0])) + parts[0] + CRLF * 2]
    for k, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        own.append(("WARC-Segment-Total-Length", str(len(block)) if k == len(parts) else None))
        out.append(_header(own, len(part)) + part + CRLF * 2)
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of each record of a file, gzipped as a whole, by record, or not at all."""
    if data[:2] == b"\x1f\x8b":
        # not gzip.decompress, which copies all that is left of a file for each of its members
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            data = f.read()
    at = 0
    while at < len(data):
        end = data.find(CRLF * 2, at)
        lines = data[at : max(end, at)].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        at = end + 4 + n
        if data[at : at + 4] != CRLF * 2:
            raise ValueError(f"no end of record at byte {at}")
        yield head, data[end + 4 : at]
        at += 4


def _id(name: str) -> int | None:
    own = name.split(":")[2].strip(">")
    return int(own) if own else None


def finished(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A whole record as a row of ``RECORDS``; checks the payload against its digest."""
    http, _, body = block.partition(CRLF * 2)
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    page = _id(head["warc-record-id"])
    if head["warc-type"] == "revisit":
        return page, int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1]), digest, "revisit", _id(head["warc-refers-to"])
    payload = unchunked(body) if re.search(rb"(?i)\ntransfer-encoding: *chunked", http) else body
    if sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
    return page, len(payload), digest, "response", None


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block whose (segment number, total length or None, part) these are; a resource written more than once repeats them."""
    once = sorted(set(parts), key=lambda p: p[0])
    block = b"".join(p[2] for p in once)
    if [p[0] for p in once] != list(range(1, len(once) + 1)) or once[-1][1] != len(block) or len(set(Counter(parts).values())) > 1:
        raise ValueError("segments are missing or of the wrong length")
    return block


def write(df: DataFrame, out: str, payload: str = "html", id_col: str = "page_id", url: str = "url", segment: int = SEGMENT_BYTES) -> None:
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"ids of {id_col} are no whole numbers")
    if not 0 < segment <= MOST_SEGMENT:
        raise ValueError(f"segments have up to {MOST_SEGMENT} bytes")
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    size = F.octet_length("body")
    pages = pages.withColumn("sum", F.when(size >= REVISIT_BYTES, F.unhex(F.sha2("body", 256))))
    shared = pages.where("sum is not null").select("sum", "id").groupBy("sum").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").select("sum", "keep")
    # hot payloads are on the left, whose partitions adaptive execution can split
    revisit = F.col("n_sum").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    rows = pages.join(shared.withColumnRenamed("sum", "n_sum"), F.col("sum") == F.col("n_sum"), "left")
    rows = rows.select("id", "url", "body", revisit.alias("revisit"), "keep")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, block, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(block)[:-1]], pa.binary())], ["value"])
        for batch in batches:
            for page, link, data, again, keep in zip(*(batch.column(k) for k in range(5)), strict=True):
                refers = (keep.as_py(),) if again.as_py() else None
                for rec in records(page.as_py(), f"{part}-{count}", link.as_py(), data.as_py(), refers, segment):
                    block.append(gzip.compress(rec, LEVEL, mtime=0))
                    size += len(rec)
                    if size >= BLOCK_BYTES:
                        yield row()
                        block, size = [], 0
                count += 1
        if block:
            yield row()

    writer = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write
    writer.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).text(out)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_NAMED_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_PARSED_KINDS = [*_NAMED_KINDS, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
_NAMED_NAMES, _PARSED_NAMES = ([x.split()[0] for x in schema.split(", ")] for schema in (_NAMED, _PARSED))


def _named(head: dict[str, str], block: bytes) -> tuple:
    return (*finished(head, block), head["warc-record-id"], head.get("warc-refers-to"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for h, b in parse(content.as_py()):
                if "warc-segment-number" in h:
                    total = h.get("warc-segment-total-length")
                    origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                    rows.append((*[None] * len(_NAMED_KINDS), origin, int(h["warc-segment-number"]), total and int(total), json.dumps(h), b))
                    size += len(b)
                elif h["warc-type"] in ("response", "revisit"):
                    rows.append((*_named(h, b), *[None] * 5))
                if size >= BLOCK_BYTES:
                    yield _batch(rows, _PARSED_KINDS, _PARSED_NAMES)
                    rows, size = [], 0
            yield _batch(rows, _PARSED_KINDS, _PARSED_NAMES)


def _joined(group: pa.Table) -> pa.Table:
    own = group.to_pylist()
    block = reassembled([(p["number"], p["total"], p["block"]) for p in own])
    rows = [_named(json.loads(p["head"]), block) for p in own if p["number"] == 1]
    return pa.Table.from_batches([_batch(rows, _NAMED_KINDS, _NAMED_NAMES)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row of ``RECORDS`` for each response or revisit in the archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed, _ = stored(files.mapInArrow(_parsed, _PARSED), "warc-records")
    parts = parsed.where("number is not null").select("origin", "number", "total", "head", "block")
    segmented, _ = stored(parts.groupBy("origin").applyInArrow(_joined, _NAMED), "warc-segmented")
    every = parsed.where("number is null").select(*_NAMED_NAMES).unionByName(segmented)
    # revisits of one response come down to one row first
    asked = every.where("record_type = 'revisit'").select("target", "payload_digest", "payload_bytes").distinct()
    there = every.where("record_type = 'response'").select(F.col("name").alias("target"), "payload_digest", "payload_bytes")
    if lost := asked.join(there, asked.columns, "left_anti").select("target").head(1):
        raise ValueError(f"a revisit refers to {lost[0][0]}, which is no response with its digest and length")
    return every.select(*[x.split()[0] for x in RECORDS.split(", ")])

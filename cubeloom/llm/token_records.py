"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

File format (all integers little-endian): a file is a sequence of blocks, a
block a sequence of frames and then the byte ``0x0A``.  A frame is::

    0x52 | length u64 | masked CRC-32 of length u32 | record | masked CRC-32 of record u32

and a record is ``flags u8, doc_id i64, shard u32, start u64`` and the ids, as
u16 where flag 1 is set and as u32 otherwise; flag 2 marks a null doc_id.
``start`` counts the ids of the shard before this document.  A checksum ``c``
is masked as ``((c >> 15) | (c << 17)) + 0xa282ead8`` modulo ``2 ** 32``.

Documents are encoded where they are read.  A pass over the ids alone finds the
bounds of the shards, and what is shuffled, once, are packed ids: to shards by
ranges of ``doc_id``, sorted within, so ascending shards hold ascending ids.
An id with so many rows that several bounds equal it goes to all the shards
between them, by a checksum of the text's ids.  Spark's text writer puts the
blocks into files of at most ``FILE_BLOCKS`` blocks through the cluster's file
system and commits whole tasks only.  Reading the files back checks every frame
and yields the offset index, which is written beside them as Parquet.

Defined results: a null text has the end id alone; a null doc_id sorts first;
rows that repeat a doc_id are ordered by that checksum, then by their ids, and
each written; a text of any length is one record, in memory of a small multiple
of its size; an empty table gives no files to speak of and an empty index; only
the two columns named are read, whatever others there are; ids that are no whole
numbers raise ``TypeError``, as the format has a 64-bit integer for them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm.bpe import encoder_of

END_ID = 0
BLOCK_BYTES, FILE_BLOCKS = 4_000_000, 16
#: Frames that a fetch has in memory at a time, and the bytes of a file that one of its tasks looks at.
FETCH_ROWS, FETCH_BYTES = 256, 16_000_000
MARK, END = b"\x52", b"\x0a"
_HEAD = struct.Struct("<BqIQ")

INDEX = "file string, offset long, length long, doc_id long, shard long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    length = struct.pack("<Q", len(record))
    return b"".join((MARK, length, struct.pack("<I", masked(length)), record, struct.pack("<I", masked(record))))


def record(doc_id: int | None, shard: int, start: int, ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 65_536
    flags = narrow + 2 * (doc_id is None)
    return _HEAD.pack(flags, doc_id or 0, shard, start) + ids.astype("<u2" if narrow else "<u4").tobytes()


def parse(rec: bytes) -> tuple[int | None, int, int, np.ndarray]:
    flags, doc_id, shard, start = _HEAD.unpack_from(rec)
    return None if flags & 2 else doc_id, shard, start, np.frombuffer(rec, "<u2" if flags & 1 else "<u4", offset=_HEAD.size)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame of a file; raises ValueError where a checksum doesn't hold."""
    at, n = 0, len(data)
    while at < n:
        kind = data[at : at + 1]
        if kind == END:
            at += 1
            continue
        length = data[at + 1 : at + 9]
        if kind != MARK or n - at < 17 or struct.unpack_from("<I", data, at + 9)[0] != masked(length):
            raise ValueError(f"broken frame at byte {at}")
        size = struct.unpack("<Q", length)[0]
        rec = data[at + 13 : at + 13 + size]
        if n - at < size + 17 or struct.unpack_from("<I", data, at + 13 + size)[0] != masked(rec):
            raise ValueError(f"broken record at byte {at}")
        yield at, rec
        at += size + 17


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, id, tie, narrow, packed) of each (id, text)."""
    encoder = encoder_of(path)
    for batch in batches:
        doc_ids, at = batch.column(0), 0
        for ids, b in encoder.encode_column(batch.column(1), end_id):
            own = doc_ids[at : at + len(b) - 1]
            at += len(own)
            narrow = not len(ids) or int(ids.max()) < 65_536
            packed = ids.astype("<u2" if narrow else "<u4")
            offsets = (b * packed.itemsize).astype(np.int64)
            blobs = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            tie = np.fromiter(map(crc32, blobs.to_numpy(zero_copy_only=False)), np.int64, len(own))
            place = pc.fill_null(own, int(np.iinfo(np.int64).min)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, place, "left"), np.searchsorted(bounds, place, "right")
            shard = low + (tie * (high - low + 1) >> 32)
            columns = [pa.array(shard, pa.int32()), own, pa.array(tie), pa.array([narrow] * len(own)), blobs.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "tie", "narrow", "packed"])


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start, shard, block, size = 0, None, [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(block)], pa.binary())], ["value"])
    for batch in batches:
        shards, doc_ids, narrow = (batch.column(k).to_pylist() for k in (0, 1, 3))
        for own, doc_id, small, blob in zip(shards, doc_ids, narrow, batch.column(4), strict=True):
            if own != shard:
                shard, start = own, 0
            ids = np.frombuffer(blob.as_buffer(), "<u2" if small else "<u4")
            block.append(frame(record(doc_id, shard, start, ids)))
            start, size = start + len(ids), size + len(block[-1])
            if size >= BLOCK_BYTES:
                yield pack()
                block, size = [], 0
    if block:
        yield pack()


def _bounds(rows: DataFrame, shards: int) -> np.ndarray:
    """Ascending ids that part ``rows`` (id) in about equal shards; an id of many rows can come more than once."""
    if shards < 2:
        return np.zeros(0, np.int64)
    shares = [k / shards for k in range(1, shards)]
    got = rows.agg(F.percentile_approx(F.coalesce("id", F.lit(int(np.iinfo(np.int64).min))), shares, max(10_000, 20 * shards)).alias("b")).first()
    return np.array(got["b"] or [], np.int64)


def write(
    df: DataFrame, out: str, vocabulary: str, text: str = "text", id_col: str = "doc_id", end_id: int = END_ID, shards: int | None = None
) -> None:
    """Write ``out/records`` and ``out/index``, in ``shards`` shards (the session's number of shuffle partitions)."""
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"ids of {id_col} are no whole numbers, which the record format needs")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    bounds = _bounds(rows.select("id"), shards)
    coded = rows.mapInArrow(lambda it: _encoded(it, vocabulary, end_id, bounds), "shard int, id long, tie long, narrow boolean, packed binary")
    coded = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "tie", "packed")
    blocks = coded.mapInArrow(_framed, "value binary")
    # a cast keeps bytes as they are, and the text writer writes them as they are
    writer = blocks.select(F.col("value").cast("string")).write
    writer.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{out}/records")
    scan(spark, f"{out}/records").write.parquet(f"{out}/index")


def _files(spark: SparkSession, records: str) -> DataFrame:
    return spark.read.format("binaryFile").load(records).select("path", "content")


def scan(spark: SparkSession, records: str) -> DataFrame:
    """The offset index, from the files themselves; checks all frames."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, rec in frames(content.as_py()):
                    doc_id, shard, start, ids = parse(rec)
                    rows.append((file.as_py(), at, len(rec) + 17, doc_id, shard, start, len(ids), crc32(ids.astype("<u4"))))
                kinds = [pa.string()] + [pa.int64()] * 7
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _files(spark, records).mapInArrow(read, INDEX)


def index(spark: SparkSession, out: str) -> DataFrame:
    """The stored offset index with ``start`` counted over all shards: (doc_id, start, n_tokens, ids_crc32, file, offset, length)."""
    rows = spark.read.schema(INDEX).parquet(f"{out}/index")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per shard
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(shards, "shard").withColumn("start", F.col("base") + F.col("start")).drop("base", "shard")


#: Schemes of file systems that a worker opens by itself, to seek; files of others are read whole by Spark's reader.
SEEKABLE = {"file", "hdfs", "s3", "gs"}


def fetch(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in ``wanted`` (doc_id), in any order; only their frames are read and parsed."""
    places = spark.read.schema(INDEX).parquet(f"{out}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    names = ["doc_id", "ids"]

    def batch_of(frames_read: Iterator[bytes]) -> pa.RecordBatch:
        found = [parse(next(frames(x))[1]) for x in frames_read]
        ids = pa.array([x[3].tolist() for x in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), ids], names)

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, file = None, None
        for batch in batches:
            for k in range(0, len(batch), FETCH_ROWS):
                read = []
                for own, at, size in zip(*(c.to_pylist() for c in batch[k : k + FETCH_ROWS].columns), strict=True):
                    if own != name:
                        system, path = fs.FileSystem.from_uri(own)
                        name, file = own, system.open_input_file(path)
                    read.append(file.read_at(size, at))
                yield batch_of(iter(read))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets, sizes in zip(*(batch.column(k) for k in range(3)), strict=True):
                data = memoryview(content.as_buffer())
                yield batch_of(bytes(data[i : i + n]) for i, n in zip(offsets.as_py(), sizes.as_py(), strict=True))

    first = places.select("file").first()
    if first is None or first["file"].partition(":")[0] in SEEKABLE:
        dealt = places.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / FETCH_BYTES)).sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(sought, "doc_id long, ids array<long>")
    places = places.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))
    files = _files(spark, f"{out}/records")
    joined = files.join(places, files["path"] == places["file"]).select("content", F.col("at.offset").alias("offsets"), F.col("at.length").alias("sizes"))
    return joined.mapInArrow(whole, "doc_id long, ids array<long>")

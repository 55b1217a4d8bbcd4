import gzip
import random
import zlib
from hashlib import sha1

import pytest

from cubeloom.llm import warc


def brute(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        keep = max((p for p in same if p is not None), default=None)
        again = len(data) >= 1000 and len(same) > 1 and page != keep
        out.append((page, len(data), sha1(data).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.org/x y\r\nz", "é" * 600), (7, "http://a.org/", "é" * 600), (3, None, "é" * 600), (4, "u", "s" * 999), (5, "u", "s" * 999),
    (6, "u", None), (8, "", ""), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n0\r\n\r\n" * 3), (10, "u", "big" * 100_000), (11, "u", "big" * 100_000),
    (12, "u", "q" * 70_000), (12, "u", "q" * 70_000), (None, "u", "é" * 600), (13, "u", "x" * 1000),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, keep int").repartition(3)
    warc.write(df, f"file://{tmp_path}/a")
    got = sorted((tuple(r) for r in warc.read(spark, f"file://{tmp_path}/a").collect()), key=str)
    assert got == brute(ROWS)
    warc.write(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read(spark, f"file://{tmp_path}/b").count() == 0


def test_chunked_and_segments():
    rng = random.Random(0)
    for n in (0, 1, 10, 8192, 8193, 50_000):
        data = rng.randbytes(n)
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"5;x=1\r\nhello\r\n0\r\nTrailer: a\r\n\r\n") == b"hello"
    for broken in (b"", b"5\r\nhell", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c")]
    assert warc.reassembled(parts) == b"abc"
    for bad in (parts[:2], [parts[0], parts[2]], [(1, 5, b"a")]):
        with pytest.raises(ValueError):
            warc.reassembled(bad)


def test_parse_forms():
    recs = warc.records(5, "0-0", "http://x/", b"payload", None) + warc.records(6, "0-1", None, b"p" * 2000, (5,))
    for data in (b"".join(recs), gzip.compress(b"".join(recs)), b"".join(map(gzip.compress, recs))):
        got = [warc.finished(h, b) for h, b in warc.parse(data)]
        assert got == [(5, 7, sha1(b"payload").hexdigest(), "response", None), (6, 2000, sha1(b"p" * 2000).hexdigest(), "revisit", 5)]
    with pytest.raises(ValueError):
        list(warc.parse(b"".join(recs)[:-9]))
    with pytest.raises(ValueError):
        head, block = next(warc.parse(recs[0]))
        warc.finished(head, block.replace(b"payload", b"payloaD"))


def _records(folder):
    """(header fields, gzip members) of all files below a folder, read without the operator."""
    out, members = {}, 0
    for file in folder.glob("part-*"):
        data = file.read_bytes()
        while data:
            d = zlib.decompressobj(31)
            rec = d.decompress(data) + d.flush()
            assert d.eof
            data, members = d.unused_data, members + 1
            head = dict(x.split(": ", 1) for x in rec.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
            out.setdefault(head["WARC-Record-ID"], []).append(head)
    return out, members


def test_every_reference_can_be_followed(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    warc.write(df, f"file://{tmp_path}/a")
    found, members = _records(tmp_path / "a")
    assert members == sum(map(len, found.values())) > len(ROWS)  # a member for each record
    revisits = [h for hs in found.values() for h in hs if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 4
    for h in revisits:
        assert {t["WARC-Payload-Digest"] for t in found[h["WARC-Refers-To"]] if t["WARC-Type"] == "response"} == {h["WARC-Payload-Digest"]}
    for hs in found.values():
        assert all(h["WARC-Segment-Origin-ID"] in found for h in hs if h["WARC-Type"] == "continuation")


def test_a_lost_response_is_found(spark, tmp_path):
    recs = warc.records(6, "0-1", None, b"p" * 2000, (5,))
    (tmp_path / "x").write_bytes(b"".join(map(gzip.compress, recs)))
    with pytest.raises(ValueError, match="no response"):
        warc.read(spark, f"file://{tmp_path}/x")
    (tmp_path / "x").write_bytes(b"".join(map(gzip.compress, recs + warc.records(5, "0-0", None, b"p" * 2000, None))))
    assert warc.read(spark, f"file://{tmp_path}/x").count() == 2


def test_odd_arguments(spark, tmp_path):
    df = spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string")
    with pytest.raises(TypeError, match="whole numbers"):
        warc.write(df, str(tmp_path))
    with pytest.raises(ValueError, match="segments"):
        warc.write(df.withColumn("page_id", df.page_id.try_cast("long")), str(tmp_path), segment=10**8)

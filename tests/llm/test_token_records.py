from zlib import crc32

import numpy as np
import pytest

from cubeloom.llm import token_records as R
from cubeloom.llm.queries import vocabulary

TEXTS = [(k, f"Text number {k} " + "with some words " * (k % 7)) for k in range(200)] + [(1_000, None), (999, ""), (998, "ä\U0001f600 " * 50)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("records"))
    R.write(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(5), out, vocabulary())
    return out


def expected():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    return {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, R.END_ID] for d, t in sorted(TEXTS)}


def test_files_hold_all_ids_in_order(spark, written):
    at = 0
    rows = {r["doc_id"]: r for r in R.index(spark, written).collect()}
    for doc_id, ids in expected().items():
        row = rows[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(TEXTS)


def test_shuffled_reads(spark, written):
    wanted = [998, 3, 150, 1_000]
    got = {r["doc_id"]: r["ids"] for r in R.fetch(spark, written, spark.createDataFrame([(w,) for w in wanted], "doc_id long")).collect()}
    assert got == {w: expected()[w] for w in wanted}


def test_damage_is_found():
    data = R.frame(R.record(7, 0, 5, np.array([1, 2, 70_000], "<u4"))) + R.END + R.frame(R.record(None, 1, 0, np.array([0], "<u4")))
    (_, a), (at, b) = R.frames(data)
    assert R.parse(a)[:3] == (7, 0, 5) and R.parse(a)[3].tolist() == [1, 2, 70_000] and R.parse(b)[0] is None and data[at : at + 1] == R.MARK
    for k in (3, 10, 20, len(data) - 1):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError, match="broken"):
            list(R.frames(bytes(broken)))
    with pytest.raises(ValueError, match="broken"):
        list(R.frames(data[:-2]))


def test_hot_ids_are_dealt_to_several_shards_and_stay_in_order(spark, tmp_path):
    rows = [(5, f"text {k}") for k in range(300)] + [(None, f"none {k}") for k in range(40)] + [(k, "one") for k in range(60)]
    R.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), str(tmp_path), vocabulary(), shards=8)
    index = sorted(R.index(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in index]
    assert ids == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r["start"] for r in index] == np.cumsum([0, *[r["n_tokens"] for r in index[:-1]]]).tolist()
    shards = spark.read.parquet(f"{tmp_path}/index").where("doc_id = 5").groupBy("shard").count().collect()
    assert len(shards) > 3 and max(r["count"] for r in shards) < 150


def test_ids_that_are_no_whole_numbers_are_refused(spark, tmp_path):
    with pytest.raises(TypeError, match="whole numbers"):
        R.write(spark.createDataFrame([("doc-a", "x")], "doc_id string, text string"), str(tmp_path), vocabulary())


def test_fetch_without_seeking_reads_the_same(spark, written, monkeypatch):
    wanted = spark.createDataFrame([(w,) for w in (998, 3, 999, 77_777)], "doc_id long")
    monkeypatch.setattr(R, "SEEKABLE", set())
    got = {r["doc_id"]: r["ids"] for r in R.fetch(spark, written, wanted).collect()}
    assert got == {w: expected()[w] for w in (998, 3, 999)}
    assert R.fetch(spark, written, wanted.where("doc_id > 5000")).count() == 0

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator and stage."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import bpe, decontamination, exact_dedup, html_text, quality, secrets, simhash, token_records, url_rules, warc
from cubeloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
LONG = " ".join(f"word{k % 977}" for k in range(120_000))
ROWS = [
    (1, "one good text about rivers and hills.", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", None, 4),
    (5, LONG, "en", "a", 9),
    (5, LONG, "en", "a", 9),
    (6, LONG.upper(), "en", "a", 9),
    (None, "no id here", "en", "a", 9),
    (None, None, None, None, None),
    (7, "tie of a text", "en", "a", 9),
    (7, "tie of a text", "de", "b", 9),
    (8, "äÖ \U0001f600 password = hunter22hunter", "de", "b", 9),
]
CLASHES = [
    "row", "id", "ids", "fp", "fingerprint", "component_id", "kept_id", "bad_id", "digest", "body", "keep", "n", "m", "i", "salt", "texts", "Score", "predicted",
    "held_out", "n_tokens", "start", "value", "spans", "n_hex", "host", "path", "rule", "verdict", "target", "best", "low", "n_words", "hits", "items", "segment", "place",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def wide(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def pages_of(df):
    html = F.when(F.col("text").isNotNull(), F.concat(F.lit("<body><p>"), "text", F.lit("</p>")))
    return df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/en/"), "lang").alias("url"), html.alias("html"), *[c for c in df.columns if c in CLASHES])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of labels and benchmark items that the stages read; with nulls and repeated rows, and empty."""
    out = {}
    for kind, labels, items in (
        ("some", [(1, 1, 0), (1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, None), (7, 1, 1)], [("x", "good text about rivers"), ("y", None), (None, "a tie"), ("x", "good text about rivers"), ("z", "")]),
        ("none", [], []),
    ):
        base = str(tmp_path_factory.mktemp(kind))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
        out[kind] = base
    return out


@pytest.mark.parametrize("kind", ["some", "none"])
@pytest.mark.parametrize("shape", ["rows", "wide", "empty"])
@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, docs, tables, kind, shape, stage):
    df = {"rows": docs, "wide": wide(docs), "empty": docs.where("false")}[shape]
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, df, tables[kind])
    got = out.collect()
    if stage < 4:
        assert out.columns == df.columns
    assert len(got) <= df.count()
    ids = [r["doc_id"] for r in got]
    if shape == "empty":
        assert not got
    elif name == "exact_dedup":
        assert sorted(ids, key=str) == sorted([1, 3, 4, 6, 7, 8, None], key=str)
    elif name == "benchmark_decontamination":
        assert sorted(ids, key=str) == sorted([r[0] for r in ROWS if kind == "none" or r[0] not in (1,)], key=str)
    elif name == "byte_level_bpe":
        assert len(ids) == len(ROWS)


@pytest.mark.parametrize("shape", ["rows", "wide", "empty"])
def test_operators(spark, docs, tables, tmp_path, shape):
    df = {"rows": docs, "wide": wide(docs), "empty": docs.where("false")}[shape]
    n = df.count()
    labels, items = (spark.read.parquet(f"{tables['some']}/{t}.parquet") for t in ("labels", "benchmark"))
    report = decontamination.report(df, items).collect()
    assert len(report) == n
    if n:
        found = {(r["doc_id"], r["n_words"], r["n_items"]) for r in report}
        assert {(1, 7, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 120_000, 0), (7, 4, 0), (None, 0, 0), (None, 3, 0)} <= found  # "a tie" is no window of its own here
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.grouped(df).collect()}
    assert not n or {(3, 2), (2, 2), (4, 2), (5, 5), (6, 5)} <= groups
    tripped = bpe.round_trip(df, vocabulary()).collect()
    assert len(tripped) == n
    assert all(r["decoded_sha256"] == sha256((r["text"] or "").encode()).hexdigest() and (r["n_tokens"] > 0) == bool(r["text"]) for r in tripped)
    assert len(bpe.encode_with_offsets(df, vocabulary()).collect()) == n
    assert len(bpe.decode(bpe.encode(df.drop("ids"), vocabulary()), vocabulary()).collect()) == n
    found = exact_dedup.annotate(df).collect()
    assert len(found) == n and (not n or sum(r["kept"] for r in found) == 7)
    scanned = secrets.scan(df).collect()
    assert len(scanned) == n and (not n or [r["spans"] for r in scanned if r["doc_id"] == 8] == ["assign:5:30"])
    judged = quality.assess(df, labels).collect()
    assert len(judged) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in judged)
    assert len({r["score"] for r in judged if not (r["text"] or "").strip()}) <= 1  # the bias alone
    pages = pages_of(df)
    urls = url_rules.judge(pages).collect()
    assert len(urls) == n
    assert all((r["host"], r["path"], r["verdict"]) == (("a.net", r["url"][12:], "block") if r["url"] else ("", "", "allow")) for r in urls)
    texts = html_text.main_text(pages).collect()
    assert len(texts) == n and all(r["n_chars"] == len(r["text"]) for r in texts)
    assert not n or {(r["page_id"], r["text"]) for r in texts} >= {(1, "one good text about rivers and hills."), (2, ""), (3, ""), (4, ""), (5, LONG), (8, "äÖ \U0001f600 password = hunter22hunter")}
    warc.write(pages, f"{tmp_path}/warc")
    archived = warc.read(spark, f"{tmp_path}/warc").collect()
    assert len(archived) == n
    assert not n or {(r["page_id"], r["payload_bytes"], r["record_type"]) for r in archived} >= {(2, 0, "response"), (5, len(LONG) + 13, "response"), (3, 13, "response")}
    token_records.write(df, f"{tmp_path}/tokens", vocabulary())
    index = token_records.index(spark, f"{tmp_path}/tokens").collect()
    assert len(index) == n
    assert not n or {(r["doc_id"], r["n_tokens"]) for r in index} >= {(2, 1), (3, 1), (None, 1)}
    assert sorted(r["start"] for r in index) == sorted(sum(x["n_tokens"] for x in index if x["start"] < r["start"]) for r in index)

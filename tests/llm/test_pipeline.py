"""The pipeline against a brute-force version of each stage, judged on the stage's own input."""

import os
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import quality, simhash
from cubeloom.llm.common import fold_ascii, table
from cubeloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def fold(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def best_of_equal(docs):
    best = {}
    for d, t in docs.items():
        best[fold(t)] = max(best.get(fold(t), d), d)
    return {d: docs[d] for d in best.values()}


def one_of_near(docs):
    prints = {d: simhash.fingerprint(t) for d, t in docs.items()}
    group = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and group[b] < group[a]:
                    group[a], changed = group[b], True
    return {d: docs[d] for d in docs if group[d] == d}


def without_leaks(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(8, len(w))
        windows[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)
    leaks = lambda w: any(tuple(w[k : k + n]) in own for n, own in windows.items() if n for k in range(len(w) - n + 1))
    return {d: t for d, t in docs.items() if not leaks(words(t))}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    weights = quality.fit(docs, quality.held_out(table(spark, SF, "labels")).where("not held_out"))
    import pyarrow as pa

    want = dict(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if name == "quality_classifier":
            want = {d: t for d, t in want.items() if quality.scores(pa.array([t], pa.string()), weights)[0] >= quality.THRESHOLD}
        elif name == "exact_dedup":
            want = best_of_equal(want)
        elif name == "simhash_near_dedup":
            want = one_of_near(want)
        elif name == "benchmark_decontamination":
            assert len(without_leaks(want, items)) < len(want)
            want = without_leaks(want, items)
        assert sorted(r["doc_id"] for r in rows) == sorted(want), name
        if k < 4:
            assert docs.columns == table(spark, SF, "documents").columns
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    assert set(got) == set(want)
    for d, t in want.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d]["decoded_sha256"] == sha256((t or "").encode()).hexdigest()


def test_fold_of_texts(spark):
    rows = [("ABC",), ("ÄBİZ",), ("",), ("a\U0001f600Q",)]
    got = spark.createDataFrame(rows, "t string").select(fold_ascii(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in got] == [fold(t) for (t,) in rows]

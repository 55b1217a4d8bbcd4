from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cubeloom.llm import exact_dedup

ROWS = [
    (1, "Same"), (2, "same"), (9, "SAME"), (9, "same"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "same"), (None, "alone"),
    (7, "x" * 100_000), (8, "X" * 100_000), (10, "abcd"), (11, "dcba"), (12, "dcba"), (10, "abcd"),
]


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[fold(t)].append(k)
    out = []
    for ids in groups.values():
        top = max((k for k in ids if k is not None), default=None)
        left = 1
        for k in ids:
            kept = k == top and left > 0
            left -= kept
            out.append((k, top, len(ids), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda c: F.unhex(F.hex(F.length(c)))])
def test_annotate_and_deduplicate(spark, digest):
    df = spark.createDataFrame([(k, t, "z", 1) for k, t in ROWS], "doc_id long, text string, digest string, n int").repartition(5)
    got = sorted((tuple(r)[:4] for r in exact_dedup.annotate(df, digest=digest, salts=2).collect()), key=str)
    assert got == brute(ROWS)
    kept = exact_dedup.deduplicate(df, digest=digest)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _, _, keep in brute(ROWS) if keep), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.annotate(df).count() == 0 and exact_dedup.deduplicate(df).count() == 0

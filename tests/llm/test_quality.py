import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cubeloom.llm import quality

GOOD = "the of and in a to is that for it with as on by from reading water river stone garden house morning light".split()


def document(rng, good):
    words = rng.choices(GOOD, k=rng.randint(5, 60))
    return " ".join(words) + "." if good else " ".join(w.upper() + "!!" if rng.random() < 0.8 else w for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, document(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(400)]


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t, _ in rows], "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.assess(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, _, q in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, " \n "), (2, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(9, 1)], "doc_id long, quality int")
    got = quality.assess(docs, labels).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)  # nothing to learn from
    assert quality.assess(docs.limit(0), labels).count() == 0


def test_batches_do_not_matter(rows):
    w = np.random.default_rng(0).normal(size=2**quality.BITS + 1).astype(np.float32)
    texts = [None, "", *[t for _, t, _ in rows[:40]], "é ü ß"]
    whole = quality.scores(pa.array(texts), w)
    assert np.allclose(whole, [quality.scores(pa.array([t], pa.string()), w)[0] for t in texts])
    by_hand = [1 / (1 + np.exp(-(w[a] @ x))) for a, x in quality.sparse(pa.array(texts))]
    assert np.allclose(whole, by_hand)


def test_training_by_hand():
    """The weights of follow-the-regularised-leader, coordinate by coordinate."""
    import math
    import random

    rng = random.Random(2)
    rows = []
    for _ in range(40):
        at = sorted(rng.sample(range(30), 5))
        rows.append((np.array([*at, 2**quality.BITS]), np.array([*(rng.random() for _ in at), 1.0]), rng.randrange(2)))
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[k]) - z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for at, x, y in rows:
            w = {k: weight(k) for k in at.tolist()}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in zip(at.tolist(), x.tolist(), strict=True))))
            for k, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (p - y) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
    got = quality.train(rows, epochs=2)
    assert np.allclose(got[[*range(30), 2**quality.BITS]], [weight(k) for k in (*range(30), 2**quality.BITS)], atol=1e-6)
    assert not got[30:-1].any()

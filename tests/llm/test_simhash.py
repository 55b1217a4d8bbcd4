import random
import struct

import numpy as np
import pytest
import xxhash

from cubeloom.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """rows: (id, fp); ids not null."""
    out = list(range(len(rows)))

    def find(x):
        while out[x] != x:
            x = out[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                out[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return [(k, fp, low[find(i)]) for i, (k, fp) in enumerate(rows)]


TEXTS = ["", None, "   \n", "One", "one two THREE", "a b c d e f g h", "A b c d e  f\tg h", "É é Ä\x0bß x", "x " * 300, "und so weiter z q"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    every = simhash.masks(4)
    assert len(every) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & diff for m in every)


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(8):
            rows.append((len(rows) * 3, fp))
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                fp ^= 1 << b
    rows += [(500, rows[0][1]), (1, rows[7][1])]
    df = spark.createDataFrame([(fp - 2**64 if fp >= 2**63 else fp,) for fp in {r[1] for r in rows}], "fp long").selectExpr("fp as node", "fp")
    for block in (2048, 4):  # in one piece, and in blocks
        found = {r.node: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
        name = lambda fp: found.get(s := struct.unpack("<q", struct.pack("<Q", fp))[0], s)
        got = {frozenset(k for k, fp in rows if name(fp) == x) for x in {name(r[1]) for r in rows}}
        want = brute_components(rows)
        assert got == {frozenset(k for k, _, c in want if c == x) for x in {c for _, _, c in want}}


def test_grouped_whole(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today with all its friends".split()
    texts = [" ".join(base * 8), " ".join(base * 8).upper(), " ".join(base * 8) + " end", *TEXTS, "x " * 300]
    rows = [(100 - i, t, "extra") for i, t in enumerate(texts)] + [(50, "One", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(tuple(r) for r in simhash.grouped(df).collect())
    want = sorted((k, struct.unpack("<q", struct.pack("<Q", fp))[0], c) for k, fp, c in brute_components([(r[0], brute_fingerprint(r[1])) for r in rows]))
    assert got == want
    kept = sorted(r.doc_id for r in simhash.deduplicate(df).collect())
    assert kept == sorted(k for k, _, c in want if k == c)
    assert simhash.deduplicate(df).columns == df.columns
    assert simhash.grouped(df.limit(0)).count() == 0


def broadcast_rows(spark, first):
    """Rows of each broadcast of the executions from the id ``first``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for k in (runs.apply(i).executionId() for i in range(runs.size())):
        if k >= first:
            values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                found = [node.metrics().apply(i) for i in range(node.metrics().size())]
                ids = [m.accumulatorId() for m in found if m.name() == "number of output rows"]
                if node.name().startswith("BroadcastExchange"):
                    out += [int(values.apply(i).replace(",", "")) for i in ids if values.contains(i)]
    return out


def test_broadcasts_stay_below_the_number_of_documents(spark):
    """The driver would hold 31 rows of each fingerprint, and 16 of each component, where these seem small."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(600)) for _ in range(60)]
    texts += [f"{t} end" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = 1 + max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    assert spark.range(3).join(spark.range(2).hint("broadcast"), "id").count() == 2
    assert max(broadcast_rows(spark, first)) == 2  # broadcasts are seen
    got = sorted((r.doc_id, r.component_id) for r in simhash.grouped(df).collect())
    want = [(k, c) for k, _, c in brute_components([(k, simhash.fingerprint(t)) for k, t in enumerate(texts)])]
    assert got == want and sum(k != c for k, c in got) > 30
    assert max(broadcast_rows(spark, first)) <= len(texts)


def test_op2_broadcasts_only_what_is_linked(spark, tmp_path):
    """Files of equal or similar values are small, but not the rows that a driver would hold of them."""
    from cubeloom.llm.queries import op2_simhash

    texts = ["one two three four", "One two three four", *(f"{k} {k * k} z" for k in range(100))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = 1 + max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op2_simhash(spark, str(tmp_path)).collect())
    want = brute_components([(k, brute_fingerprint(t)) for k, t in enumerate(texts)])
    assert got == [(k, f"{fp:016x}", c) for k, fp, c in want] and sum(k != c for k, _, c in got) == 1
    assert max(broadcast_rows(spark, first), default=0) < 50


def test_null_ids_and_hexadecimal(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "z y x w v")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.grouped(df).collect()), key=str)
    assert got == sorted([(7, 7), (None, 7), (None, None)], key=str)
    x = spark.range(1).select(simhash.hexadecimal(F.lit(-1).cast("long")).alias("a"), simhash.hexadecimal(F.lit(26).cast("long")).alias("b")).first()
    assert tuple(x) == ("f" * 16, "0" * 14 + "1a")
    assert np.uint64(2**64 - 1).view(np.int64) == -1

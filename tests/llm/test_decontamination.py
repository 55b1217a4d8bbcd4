import re
from hashlib import sha256

from cubeloom.llm import decontamination as deco

ITEMS = [
    (1, "One two three four five six seven eight nine TEN"),
    (2, "short item"),
    (3, None),
    (11, "the the the the the the the the the"),
    (12, "ninè äpfel sind, grün und rot und blau; gelb"),
    (12, "one two"),
    (None, "lonely null item here"),
    (4, "..."),
]
DOCS = [
    (1, "x one, two-three four five six seven eight y"),
    (2, "one two three four five six seven"),
    (3, "a short item and short  ITEM one two three four five six seven eight nine ten eleven"),
    (4, None),
    (5, ""),
    (6, "the " * 30),
    (7, "Ninè Äpfel ninè äpfel sind grün und rot und blau gelb"),
    (7, "nine two lonely null item here"),
    (None, "short"),
    (8, "item"),
    (9, "eight nine ten " * 500),
]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for item, body in items:
            w = words(body)
            for k in range(max(1, len(w) - 7) if w else 0):
                win = w[k : k + 8]
                for i in range(len(own) - len(win) + 1):
                    if own[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        names.add("null" if item is None else str(item))
        out.append((doc, len(own), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=str)


def frames(spark, docs=DOCS, items=ITEMS):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, segment int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_report_matches_brute_force(spark):
    docs, items = frames(spark)
    assert got(deco.report(docs, items)) == brute(DOCS, ITEMS)
    # blocks of single items, merged afterwards
    assert got(deco.report(docs, items, block_words=3)) == brute(DOCS, ITEMS)


def test_generated_texts(spark):
    import random

    rng = random.Random(3)
    w = ["a", "b", "c", "d", "é"]
    items = [(i, " ".join(rng.choices(w, k=rng.randint(1, 14)))) for i in range(12)]
    docs = [(i, " ".join(rng.choices(w, k=rng.randint(0, 80)))) for i in range(60)]
    docs += [(100 + i, f"zz {b} zz") for i, b in items]
    assert got(deco.report(*frames(spark, docs, items))) == brute(docs, items)


def test_empty_tables_and_kept_columns(spark):
    docs, items = frames(spark)
    assert deco.report(docs.limit(0), items).count() == 0
    assert got(deco.report(docs, items.limit(0))) == brute(DOCS, [])
    kept = deco.decontaminate(docs, items)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[5]}
    assert sorted(r.doc_id is not None and r.doc_id for r in kept.collect()) == sorted(d is not None and d for d, _ in DOCS if d not in bad)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "rare common other")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "other x x common rare"), (2, "rare common x x x x x x x other"), (3, "rare common")], "doc_id long, text string")
    near = deco.search(spark, deco.build_index(docs), items, reach=4)
    assert {r.id: r["items"] for r in near.collect()} == {1: ["1"], 2: [], 3: []}


def test_small_segments(spark):
    docs, items = frames(spark)
    found = deco.search(spark, deco.build_index(docs.coalesce(1), segment_words=4), items)
    assert sorted((r.n_words, len(r.hits), len(r["items"])) for r in found.collect()) == sorted((r[1], r[2], r[3]) for r in brute(DOCS, ITEMS))


def test_distributed_test_set(spark, monkeypatch):
    docs, items = frames(spark)
    monkeypatch.setattr(deco, "GROUP_WINDOWS", 2)
    assert got(deco.report(docs, items, inline_bytes=0)) == brute(DOCS, ITEMS)
    assert got(deco.report(docs, items.limit(0), inline_bytes=-1)) == brute(DOCS, [])
    index = deco.build_index(docs, segment_words=4)
    wide = [sorted(map(tuple, deco.search(spark, index, items, reach=3, inline_bytes=b).collect()), key=str) for b in (0, 10**6)]
    assert wide[0] == wide[1]


def test_many_blocks_are_one_pass(spark):
    docs, items = frames(spark, items=[(k, f"word{k} one two three four five six {w}") for k, w in enumerate(["seven", "eight"] * 30)])
    index = deco.build_index(docs)
    plans = [deco.search(spark, index, items, block_words=w)._jdf.queryExecution().toString() for w in (8, 10_000)]
    assert len(plans[0]) == len(plans[1])
    assert len(deco.search(spark, index, items, block_words=8).collect()) == len(DOCS)


def test_ids_of_any_type_and_bounds(spark):
    import pytest

    docs = spark.createDataFrame([(f"doc-{d}", t) for d, t in DOCS], "doc_id string, text string")
    _, items = frames(spark)
    want = sorted([(f"doc-{r[0]}", *r[1:]) for r in brute(DOCS, ITEMS)], key=str)
    assert got(deco.report(docs, items)) == want and got(deco.report(docs, items, inline_bytes=0)) == want
    kept = sorted(r["doc_id"] for r in deco.decontaminate(docs, items, min_items=1).collect())
    assert kept == sorted(f"doc-{d}" for d, t in DOCS if f"doc-{d}" not in {r[0] for r in want if r[3]})
    index = deco.build_index(docs)
    for bad in ({"window": 0}, {"window": deco.GAP}, {"reach": deco.GAP}, {"reach": -1}):
        with pytest.raises(ValueError, match="gap"):
            deco.search(spark, index, items, **bad)

"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: bit ``b`` of a text's fingerprint is 1 if it is set in over half
of the XXH64 hashes (seed 42) of the text's shingles, repeats included.

Search: every bit position gets a non-zero vector of ``r + 1`` bits, and table
``v`` (of the ``2 ** (r + 1) - 1`` non-zero ``v``) masks the positions whose
vector has an odd product with ``v``.  For any set of at most ``r`` positions
there is a ``v`` that has an even product with all their vectors, so two
fingerprints that differ in at most ``r`` bits collide in some table, always
and not just probably.

Skew: equal fingerprints come down to one row before the search.  A bucket of
many fingerprints is cut into blocks of ``BLOCK`` and every pair of blocks is a
task's work of fixed size; within it fingerprints are compared with XOR and a
bit count over whole arrays, and only a spanning forest of the links is
emitted, never the pairs.  Components are contracted by alternating large and
small stars; hot stars are joined, which adaptive execution can split.

Memory: joins with exploded rows, and that of all documents with their components,
are merges of shuffled sides and never broadcasts, whatever the threshold: Spark's
estimates leave out what an explode makes and what compression saves.  The other
joins are broadcast as the session's threshold says.

A bucket of ``n`` fingerprints costs ``n * n / BLOCK`` comparisons' worth of
tasks: exactness has that price where many unlike fingerprints share a bucket.

Defined results: a text without words has fingerprint zero and is linked like
any other; null texts count as empty; a text of any length is hashed whole, in
chunks of shingles; a component's id is null only where all its ids are; repeated
rows each get their row; an empty table gives an empty result; only the columns
named are read, whatever others there are, and ``deduplicate`` keeps all.
``components`` raises ``RuntimeError`` after ``most_rounds`` rounds, far beyond
what the logarithm of any component's size asks for; it drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm.bpe import map_column
from cubeloom.llm.common import remove_dir, shared_dir, stored

RADIUS = 4
SHINGLE_WORDS = 4
#: Fingerprints of one bucket that are compared with each other at a time.
BLOCK = 2_048
#: Shingles that are hashed before their bits are counted.
CHUNK = 65_536
#: Groups in which the fingerprints of a component meet its smallest id.
SALTS = 16


def fold_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return (text or "").encode().lower()


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    from xxhash import xxh64_intdigest

    tokens = fold_bytes(text).split()  # of bytes: at 0x20 and 0x09 to 0x0d
    if not tokens:
        return 0
    data = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(tokens) - words + 1)
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        hashes = np.array([xxh64_intdigest(data[i:j], 42) for i, j in zip(begins[k : min(n, k + CHUNK)], ends[k : k + CHUNK], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the fingerprint of each text, as a signed 64-bit integer, in place of the text."""

    def make():
        def f(texts: pa.Array) -> list[list]:
            return [np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)]

        return f

    return map_column(df, text, [(out, T.LongType(), pa.int64())], make, keep_column=False)


def masks(radius: int = RADIUS) -> list[int]:
    """The bit masks of the tables."""
    most = 2 ** (radius + 1) - 1
    vectors = [b % most + 1 for b in range(64)]
    return [sum(1 << b for b in range(64) if (vectors[b] & v).bit_count() % 2) for v in range(1, most + 1)]


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within ``a``, or between ``a`` and ``b``; places in ``a`` then ``b``."""
    nodes = a if b is None else np.concatenate([a, b])
    side = np.arange(len(nodes)) >= len(a)
    # what is not yet in a tree; a cluster of near copies empties it at once and costs little more than its size
    rest, values = np.arange(len(nodes)), nodes
    free = np.ones(len(nodes), bool)
    left, right = [], []
    for root in range(len(a)):
        if not free[root]:
            continue
        free[root] = False
        others = rest != root
        rest, values = rest[others], values[others]
        queue = [root]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(values ^ nodes[x]) <= radius
            if b is not None:
                near &= side[rest] != side[x]
            if near.any():
                found = rest[near]
                rest, values = rest[~near], values[~near]
                free[found] = False
                left.append(np.full(len(found), root))
                right.append(found)
                queue.extend(found.tolist())
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _links_of_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_a, out_b = [], []
        for mine, fps, theirs, other in zip(*(batch.column(k) for k in range(4)), strict=True):
            ids = np.array(mine.values.to_numpy(zero_copy_only=False), np.int64)
            a = np.array(fps.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            b = None
            if other.is_valid:
                b = np.array(other.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                ids = np.concatenate([ids, np.array(theirs.values.to_numpy(zero_copy_only=False), np.int64)])
            left, right = _forest(a, b, radius)
            out_a.append(ids[left])
            out_b.append(ids[right])
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a or empty)), pa.array(np.concatenate(out_b or empty))], ["a", "b"])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between rows of ``nodes`` (node, fp) whose connected components are those of all links.

    ``fp`` must be distinct.
    """
    table_masks = F.array(*[F.lit(_signed(m)).cast("long") for m in masks(radius)])
    keyed = nodes.select("node", "fp", F.posexplode(table_masks).alias("t", "mask"))
    keyed = keyed.select("node", "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # sizes first, so that a bucket of one costs nothing more and a large one is dealt to many blocks
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # estimates take the rows of an explode for one each: unless told, Spark would collect the small-looking side at the driver
    rows = keyed.hint("merge").join(sizes, ["t", "key"])
    part = F.when(F.col("n") <= block, F.lit(0)).otherwise(
        F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / (block // 2)))
    ).cast("int")
    rows = rows.withColumn("part", part)
    blocks = rows.groupBy("t", "key", "part", "n").agg(F.collect_list(F.struct("node", "fp")).alias("own"))
    blocks = blocks.select("t", "key", "part", "n", F.col("own.node").alias("ids"), F.col("own.fp").alias("fps"))
    none = F.lit(None).cast("array<bigint>")
    small = blocks.where(F.col("n") <= block).select("ids", "fps", none.alias("ids2"), none.alias("fps2"))
    # every two blocks of a large bucket, each block sent to the pairs it takes part in
    many = blocks.where(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / (block // 2)).cast("int"))
    sent = many.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    sent = sent.select(
        "t", "key", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), F.struct("part", "ids", "fps").alias("one")
    )
    pairs = sent.groupBy("t", "key", "p", "q").agg(F.array_sort(F.collect_list("one")).alias("both"))
    second = F.size("both") > 1
    # a lone block meets itself; one whose partner is empty has nothing to meet
    pairs = pairs.where(second | (F.col("p") == F.col("q"))).select(
        F.col("both")[0]["ids"].alias("ids"), F.col("both")[0]["fps"].alias("fps"),
        F.when(second, F.get("both", F.lit(1))["ids"]).alias("ids2"), F.when(second, F.get("both", F.lit(1))["fps"]).alias("fps2"),
    )
    work = small.unionByName(pairs)
    return work.mapInArrow(lambda it: _links_of_groups(it, radius), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every other node of it.

    Alternates large stars (each node's greater neighbours go to its smallest
    neighbour) with small stars (its lesser ones too), until nothing changes.
    Every round is written to the shared folder and the round before it removed.
    """
    spark = edges.sparkSession
    base = shared_dir(spark, "components")
    schema = "a long, b long"
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = f"{base}/0"
    ordered.write.parquet(path)
    before = None
    for k in range(1, most_rounds):
        now = spark.read.schema(schema).parquet(path)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        path = f"{base}/{k}"
        small.write.parquet(path)
        now = spark.read.schema(schema).parquet(path)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove_dir(spark, f"{base}/{k - 1}")
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")


def grouped(df: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row (id, fingerprint as a long, component_id) for each row of ``df``.

    ``component_id`` is the smallest id that links reach.
    """
    prints = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints, _ = stored(with_fingerprint(prints, "text", "fp"), "fingerprints")
    # equal fingerprints are one node, and carry the smallest of their ids
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    edges = links(nodes.select(F.col("fp").alias("node"), "fp"), radius)
    edges, edge_dir = stored(edges.distinct(), "links")
    roots = components(edges)
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    # a component may have any number of fingerprints: they meet its smallest id in groups by salt, merged as in links()
    linked = nodes.join(members, nodes["fp"] == members["node"]).select("fp", "low", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    lows = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = nodes.join(members, nodes["fp"] == members["node"], "left_anti").select("fp", F.col("low").alias("component_id"))
    of_print = linked.join(lows.hint("merge"), ["root", "salt"]).select("fp", "component_id").unionByName(alone)
    of_print, _ = stored(of_print, "components-of-fingerprints")
    remove_dir(df.sparkSession, edge_dir)
    # by the sizes of compressed files a broadcast could be several times what it seems
    return prints.join(of_print.hint("merge"), "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(df: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component; a row repeated with its id stays as often.

    Rows with a null id stay only where their whole component has none.
    """
    groups = grouped(df, text, id_col, radius)
    keep = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("kept_id")).distinct()
    return df.join(keep, df[f"`{id_col}`"].eqNullSafe(keep["kept_id"]), "left_semi")

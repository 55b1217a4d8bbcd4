"""Benchmark decontamination with a distributed positional inverted index.

Index: rows are taken in segments of about ``SEGMENT_WORDS`` words.  A segment
holds its sorted terms, their numbers of postings, and the positions of every
word of the training texts, delta coded, with gaps between documents that no
phrase can bridge.  Segments are written to the shared folder as Parquet, one
row each, so an index survives lost executors and serves any number of
searches.

Search: test items are cut into windows of ``WINDOW`` consecutive words (a
shorter item is one window).  In each segment the windows with an absent term
fall away at once.  For the others the postings of the rarest term give the
candidates, and the offset-adjusted postings of the further terms, from rare to
frequent, are intersected with them: exact phrases.  ``reach`` finds proximity
matches instead: places of the rarest term with every other term at most that
many words away.

A test set of up to ``INLINE_BYTES`` of text, which is looked at first, travels to
the workers in blocks of at most ``BLOCK_WORDS`` words, and one pass over the
index takes them all.  A larger one stays distributed: its distinct windows are a
table, each window is filed under the term that is rarest over the whole index,
and a join by that term tells each segment its candidates, in groups of at most
``GROUP_WINDOWS`` about; again one pass over the index matches them.

Defined results: null texts have no words; items without words have no window;
null item ids are listed as ``null`` and repeated ones once; rows that repeat
an id each get their row; ids keep their type; a text of any length is indexed
whole, in a segment of its own; an empty table gives an empty result; an empty
test set leaves every document clean; only the columns named are read, whatever
others there are, and ``decontaminate`` keeps all.  A window or reach that could
bridge two documents raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import shared_dir, utf8_bytes
from cubeloom.llm.common import stored as table_of

WINDOW = 8
SEGMENT_WORDS = 250_000
BLOCK_WORDS = 200_000
#: Documents are this many positions apart.
GAP = 1_024
MIN_ITEMS = 2
#: The largest text of a test set that goes through the driver, and the windows that a segment takes at a time beyond it.
INLINE_BYTES, GROUP_WINDOWS = 16_000_000, 20_000


def _index_schema(id_type: str) -> str:
    return f"segment long, ids array<{id_type}>, words array<int>, terms binary, counts binary, postings binary"


_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the lower-cased texts, and the number of words of each text."""
    data, offsets = utf8_bytes(texts, lower=True)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begins, ends = edges[::2], edges[1::2]
    at = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(at), pa.py_buffer(data[inside]))
    per_text = np.diff(np.searchsorted(begins, offsets))
    return words, per_text


def word_list(text: str | None) -> list[str]:
    return words_of(pa.array([text], pa.string()))[0].to_pylist()


def bases_of(counts: np.ndarray) -> np.ndarray:
    """The position of the first word of each document of a segment."""
    return np.cumsum(counts) - counts + np.arange(len(counts)) * GAP


def _segment(number: int, ids: list, texts: pa.Array) -> tuple:
    words, per_text = words_of(texts)
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy()
    order = np.argsort(which, kind="stable")
    positions = (np.arange(len(which)) + np.repeat(np.arange(len(per_text)) * GAP, per_text))[order]
    counts = np.bincount(which, minlength=len(coded.dictionary)).astype("<u4")
    starts = np.cumsum(counts) - counts
    deltas = np.diff(positions, prepend=0)
    deltas[starts] = positions[starts]
    terms = "\n".join(coded.dictionary.to_numpy(zero_copy_only=False)).encode()
    return number, ids, per_text.astype(np.int32), terms, counts.tobytes(), deltas.astype("<u4").tobytes()


def _segments(batches: Iterator[pa.RecordBatch], segment_chars: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    names = ["segment", "ids", "words", "terms", "counts", "postings"]
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        kinds = [pa.int64(), pa.list_(batch.column(0).type), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            done = sizes[at - 1] if at else 0
            n = max(1, int(np.searchsorted(sizes, done + segment_chars, "right")) - at)
            row = _segment(number, batch.column(0)[at : at + n].to_pylist(), batch.column(1)[at : at + n])
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)
            number, at = number + 1, at + n


def build_index(df: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, segment_words: int = SEGMENT_WORDS) -> str:
    """Write the index of all rows of ``df``; returns its path."""
    path = path or shared_dir(df.sparkSession, "positional-index")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    made = rows.mapInArrow(lambda it: _segments(it, segment_words * 6), _index_schema(dict(rows.dtypes)["id"]))
    made.write.option("compression", "zstd").parquet(path)
    return path


class Block:
    """Distinct windows and the items that have them."""

    def __init__(self, spans: dict[tuple[str, ...], set[str]]):
        self.terms = sorted({w for span in spans for w in span})
        code = {w: k for k, w in enumerate(self.terms)}
        self.windows = [(np.array([code[w] for w in span]), sorted(names)) for span, names in spans.items()]
        width = max((len(w) for w, _ in self.windows), default=1)
        # short windows repeat their last term so that all fit one matrix
        self.matrix = np.array([np.pad(w, (0, width - len(w)), "edge") for w, _ in self.windows], np.int64).reshape(-1, width)


def windows_of(words: list[str], window: int) -> list[tuple[str, ...]]:
    return [tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1) if words else 0)]


def blocks(items: Iterator[tuple[str | None, str | None]], window: int, block_words: int) -> Iterator[Block]:
    """Blocks of whole items with at most ``block_words`` words (or one item)."""
    own: dict[tuple[str, ...], set[str]] = {}
    size = 0
    for item, body in items:
        words = word_list(body)
        if own and size + len(words) > block_words:
            yield Block(own)
            own, size = {}, 0
        for span in windows_of(words, window):
            own.setdefault(span, set()).add(item if item is not None else "null")
        size += len(words)
    if own:
        yield Block(own)


def _present(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(values, wanted)
    return values[np.minimum(at, len(values) - 1)] == wanted


def matches(block: Block, terms: pa.Array, counts: np.ndarray, deltas: np.ndarray, reach: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a window, ascending positions at which it begins) in one segment.

    With ``reach``, the positions of its rarest term that have all its other terms within reach.
    """
    found = pc.index_in(pa.array(block.terms, pa.large_string()), value_set=terms)
    local = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(counts) - counts
    cache: dict[int, np.ndarray] = {}

    def postings(term: int) -> np.ndarray:
        if term not in cache:
            cache[term] = np.cumsum(deltas[starts[term] : starts[term] + counts[term]], dtype=np.int64)
        return cache[term]

    for k in np.flatnonzero((local[block.matrix] >= 0).all(axis=1)).tolist():
        own = local[block.windows[k][0]]
        order = np.argsort(counts[own], kind="stable").tolist()
        hits = postings(own[order[0]]) - (0 if reach is not None else order[0])
        for j in order[1:]:
            if not len(hits):
                break
            other = postings(own[j])
            if reach is None:
                hits = hits[_present(other, hits + j)]
            else:
                at = np.searchsorted(other, hits - reach)
                hits = hits[other[np.minimum(at, len(other) - 1)] <= hits + reach] if len(other) else hits[:0]
                hits = hits[np.searchsorted(other, hits - reach) < len(other)]
        if len(hits):
            yield k, hits


def _search(batches: Iterator[pa.RecordBatch], given: list[Block] | None, reach: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of documents; the blocks are given, or each segment has its own windows and their items as last columns."""
    names = ["segment", "place", "id", "n_words", "hits", "items"]
    for batch in batches:
        own = zip(batch.column(6), batch.column(7), strict=True) if given is None else [None] * len(batch)
        kinds = [pa.int64(), pa.int64(), batch.column(1).type.value_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
        for segment, ids, words, blob, counts, postings, listed in zip(*(batch.column(k) for k in range(6)), own, strict=True):
            per_doc = np.array(words.values.to_numpy(zero_copy_only=False), np.int64)
            bases = bases_of(per_doc)
            ends = bases + per_doc
            terms = blob.as_py().decode().split("\n")
            sizes = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
            deltas = np.frombuffer(postings.as_py(), "<u4")
            hit: dict[int, list[np.ndarray]] = {}
            items: dict[int, set[str]] = {}
            wanted = given
            if wanted is None:
                pairs = zip(listed[0].as_py() or [], listed[1].as_py() or [], strict=True)
                wanted = [Block({tuple(w): set(n) for w, n in pairs})]
            for block in wanted if len(sizes) else []:
                for k, at in matches(block, pa.array(terms, pa.large_string()), sizes, deltas, reach):
                    span = np.arange(len(block.windows[k][0]) if reach is None else 1)
                    docs = np.searchsorted(bases, at, "right") - 1
                    # an empty document shares no position with the one before it: take the one that holds the place
                    inside = at < ends[docs]
                    for d in np.unique(docs[inside]).tolist():
                        places = at[inside][docs[inside] == d]
                        hit.setdefault(d, []).append((places[:, None] + span).ravel() - bases[d])
                        items.setdefault(d, set()).update(block.windows[k][1])
            n = len(per_doc)
            hits = [np.unique(np.concatenate(hit[d])).tolist() if d in hit else [] for d in range(n)]
            columns = [[segment.as_py()] * n, list(range(n)), ids.as_py(), per_doc, hits, [sorted(items.get(d, ())) for d in range(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _candidates(stored: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(segment, group, spans, names): the windows whose rarest term each segment has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = list(dict.fromkeys(windows_of(word_list(body), window)))
                for k in range(0, len(spans), 4_096):
                    part = [list(s) for s in spans[k : k + 4_096]]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string())), pa.array(["null" if item is None else item] * len(part), pa.string())], ["span", "item"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, blob, counts in zip(*(batch.column(k) for k in range(3)), strict=True):
                sizes = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                own = pa.array(blob.as_py().decode().split("\n") if len(sizes) else [], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()] * len(own), pa.int64()), own, pa.array(sizes)], ["segment", "term", "n"])

    spans = items.mapInArrow(cut, "span array<string>, item string").groupBy("span").agg(F.collect_set("item").alias("names"))
    spans, _ = table_of(spans.withColumn("w", F.xxhash64("span")), "windows")
    asked = spans.select("w", "span", F.explode(F.array_distinct("span")).alias("term"))
    held = stored.select("segment", "terms", "counts").mapInArrow(terms, "segment long, term string, n long")
    held, _ = table_of(held.join(asked.select("term").distinct(), "term", "left_semi"), "terms-asked-for")
    often = held.groupBy("term").agg(F.sum("n").alias("n"))
    rarest = asked.join(often, "term").groupBy("w", "span").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count(F.lit(1)).alias("known"))
    rarest = rarest.where(F.col("known") == F.size(F.array_distinct("span"))).select("w", "span", "term")
    found = rarest.join(held.select("segment", "term"), "term").join(spans.select("w", "span", "names"), ["w", "span"])
    sizes = found.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / GROUP_WINDOWS).alias("groups"))
    found = found.join(sizes, "segment").withColumn("group", F.pmod("w", "groups"))
    found = found.groupBy("segment", "group").agg(F.collect_list(F.struct("span", "names")).alias("own"))
    return found.select("segment", F.col("own.span").alias("spans"), F.col("own.names").alias("names"))


def search(
    spark, index: str, items: DataFrame, text: str = "text", id_col: str = "item_id", window: int = WINDOW, reach: int | None = None,
    block_words: int = BLOCK_WORDS, inline_bytes: int = INLINE_BYTES,
) -> DataFrame:
    """One row (id, n_words, hits, items) for each indexed row: word places that are hit, and ids of the items, sorted as strings."""
    if not 0 < window < GAP or (reach is not None and not 0 <= reach < GAP):
        raise ValueError(f"a window or reach must be below {GAP}, the gap between documents")
    stored = spark.read.parquet(index)
    id_type = stored.schema["ids"].dataType.elementType.simpleString()
    out = f"segment long, place long, id {id_type}, n_words long, hits array<long>, items array<string>"
    asked = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text}`").alias("body"))
    size = asked.agg(F.sum(F.octet_length("body")), F.sum(F.octet_length("item"))).first()
    columns = ["segment", "ids", "words", "terms", "counts", "postings"]
    if sum(x or 0 for x in size) <= inline_bytes:
        given = list(blocks((tuple(r) for r in asked.toLocalIterator()), window, block_words))
        return stored.select(*columns).mapInArrow(lambda it: _search(it, given, reach), out).drop("segment", "place")
    own = stored.join(_candidates(stored, asked, window), "segment", "left").select(*columns, "spans", "names")
    found = own.mapInArrow(lambda it: _search(it, None, reach), out)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return found.groupBy("segment", "place", "id", "n_words").agg(union("hits"), union("items")).drop("segment", "place")


def report(df: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", min_items: int = MIN_ITEMS, **options) -> DataFrame:
    """One row (id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``df``."""
    found = search(df.sparkSession, build_index(df, text, id_col), items, **options)
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` without contaminated ones; an id goes if any of its rows is contaminated."""
    bad = report(df, items, text, id_col, **options).where("contaminated").select(F.col(id_col).alias("bad_id")).distinct()
    return df.join(bad, df[f"`{id_col}`"].eqNullSafe(bad["bad_id"]), "left_anti")


def digest(items: list[str]) -> str:
    return sha256(",".join(sorted(items)).encode()).hexdigest()

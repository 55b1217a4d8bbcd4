"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are its words and word pairs, and the shapes of words and
pairs of shapes (which classes of characters occur, how the word begins and
ends, whether it repeats the word before it), hashed into ``2 ** BITS`` places.
Each family weighs as much in a short text as in a long one.  A score is the
logistic function of a sparse dot product.

Training rows are a bounded sample: the ``SAMPLE`` labelled rows with the
smallest hash of their id among those that the caller allows for training.
Their sparse vectors, not their texts, go to the one task that trains.  The
weights have a fixed size of ``2 ** BITS`` floats, and are all that travels to
the scoring tasks.  Scoring covers every row and whole texts.

Defined results: null texts count as empty; a text without words has the score
of the bias alone; labels of null value or id are not used and of repeated
labels the greatest holds; without any label every score is ``0.5``; other
columns are kept, those named like a result replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm.bpe import BLOCK_BYTES, map_column
from cubeloom.llm.common import utf8_bytes

BITS = 18
SAMPLE = 12_000
EPOCHS = 3
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.0001
_FAMILIES = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))
_CLASS = np.full(256, 32, np.uint8)  # 1 lower case, 2 upper case, 4 digit, 8 stop, 16 other ASCII, 32 beyond ASCII
_CLASS[:0x80] = 16
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = 4, 2, 1
_CLASS[[0x2C, 0x2E, 0x3A, 0x3B]] = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, bounds of each word, number of words of each text); words are runs of bytes above 0x20."""
    data, offsets = utf8_bytes(texts)
    inside = data > 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begins, ends = edges[::2], edges[1::2]
    per_text = np.diff(np.searchsorted(begins, offsets))
    return data[inside], np.concatenate([[0], np.cumsum(ends - begins)]), per_text


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, number of words of each text): row ``i`` of places has the four features that word ``i`` adds."""
    data, bounds, per_text = _words(texts)
    starts = bounds[:-1]
    if not len(starts):
        return np.zeros((0, _FAMILIES), np.int64), per_text
    lens = np.diff(bounds)
    place = np.arange(len(data)) - np.repeat(starts, lens)
    word = _mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255], starts))
    kinds = _CLASS[data]
    last = data[bounds[1:] - 1]
    shape = np.bitwise_or.reduceat(kinds, starts).astype(np.uint64)
    shape |= kinds[starts].astype(np.uint64) << np.uint64(8)
    shape |= np.where(kinds[bounds[1:] - 1] & 24, last, 0).astype(np.uint64) << np.uint64(16)
    shape |= np.minimum(lens, 24).astype(np.uint64) // np.uint64(6) << np.uint64(24)
    first = np.zeros(len(starts), bool)
    first[(np.cumsum(per_text) - per_text)[per_text > 0]] = True
    before = lambda x: np.where(first, np.uint64(0), np.roll(x, 1))
    shape |= (before(word) == word).astype(np.uint64) << np.uint64(40)
    families = [word, word * np.uint64(3) + _mixed(before(word)), shape, shape * np.uint64(7) + _mixed(before(shape) + np.uint64(1))]
    out = np.stack([_mixed(x + np.uint64(k * int(_MIX) % 2**64)) >> np.uint64(64 - BITS) for k, x in enumerate(families)], axis=1)
    return out.astype(np.int64), per_text


def sparse(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text; place ``2 ** BITS`` is the bias."""
    places, per_text = features(texts)
    ends = np.cumsum(per_text)
    for i, j in zip((ends - per_text).tolist(), ends.tolist(), strict=True):
        at, n = np.unique(places[i:j], return_counts=True)
        yield np.append(at, 2**BITS), np.append(n / max(1, j - i), 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal over ``rows`` of (places, values, label), in their order."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            after = n[at] + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(n[at])) / ALPHA * w
            n[at] = after
    return weights(np.arange(2**BITS + 1)).astype(np.float32)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most ``sample`` of the labelled rows of ``df``."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "id")

    def vectors(texts: pa.Array) -> list[list]:
        out = [x for k in range(0, len(texts), 256) for x in sparse(texts[k : k + 256])]
        return [[a.astype("<i4").tobytes() for a, _ in out], [x.astype("<f4").tobytes() for _, x in out]]

    fields = [("places", T.BinaryType(), pa.binary()), ("shares", T.BinaryType(), pa.binary())]
    made = map_column(rows, "text", fields, lambda: vectors, keep_column=False)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [
            (np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(np.float64), y)
            for b in batches
            for a, x, y in zip(b["places"].to_pylist(), b["shares"].to_pylist(), b["y"].to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([train(own).tobytes()], pa.binary())], ["weights"])

    one = made.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "places")
    got = one.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else np.zeros(2**BITS + 1, np.float32)


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    places, per_text = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(weights[places].sum(axis=1, dtype=np.float64))])
    ends = np.cumsum(per_text)
    means = (sums[ends] - sums[ends - per_text]) / np.maximum(1, per_text)
    return 1 / (1 + np.exp(-np.clip(means + float(weights[-1]), -35, 35)))


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """``df`` and the score of each text."""

    def make():
        def f(texts: pa.Array) -> list[list]:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            parts, at = [np.zeros(0)], 0
            while at < len(texts):
                n = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")) - at)
                parts.append(scores(texts[at : at + n], weights))
                at += n
            return [np.concatenate(parts)]

        return f

    return map_column(df, text, [(out, T.DoubleType(), pa.float64())], make, keep_text)


def held_out(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` and held_out: whether the CRC-32 of the id as text is 2 modulo 4; false for null ids."""
    mark = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2
    return df.withColumn("held_out", F.coalesce(mark, F.lit(False)))


def assess(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, keep_text: bool = True, **options) -> DataFrame:
    """``df`` with held_out, score and predicted (1 if the score is at least ``threshold``)."""
    weights = fit(df, held_out(labels, id_col).where("not held_out"), text, id_col, **options)
    scored = score(held_out(df, id_col), weights, text, keep_text=keep_text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that are predicted 1, with the columns of ``df``."""
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias(text))
    return assess(packed, labels, text, id_col, keep_text=False, **options).where("predicted = 1").select("row.*")

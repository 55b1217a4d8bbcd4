"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.operators.materialise import remove_dir, shared_dir, stored  # noqa: F401

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` has a fast path for pure ASCII, where it means the same;
    ``translate`` goes over the rest character by character.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END, _NONE = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())


def utf8_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts, each with a line feed after it, and the bounds of each; A-Z lower-cased on demand.

    Bytes are lower-cased by a table: Arrow's own ``ascii_lower`` mixes up the
    values of an array that is a slice of another.
    """
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), _NONE), _END, _NONE)
    if not len(ended):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return _LOWER[data] if lower else data, bounds - bounds[0]


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as no column of ``taken`` has."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted

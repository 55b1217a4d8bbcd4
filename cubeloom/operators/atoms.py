"""Algebra on cubes without exploding them to identifiers.

Values of a dimension that occur in exactly the same input cubes are
interchangeable.  They are replaced by one of them (an atom), the identifier
algebra runs on atoms, and atoms are opened again at the end.  The cost follows
the number of overlap patterns, not the product of the cubes' sizes: a billion
identifiers in a few cubes stay a few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators import algebra, compression
from cubeloom.operators.materialise import written


def _tagged(sets: list[DataFrame], dims: list[str]) -> DataFrame:
    rows = [s.select(F.lit(k).alias("side"), *dims) for k, s in enumerate(sets)]
    every = reduce(DataFrame.unionByName, rows)
    return every.withColumn("cube", F.sha2(F.to_json(F.struct("side", *dims)), 256))


def _values(rows: DataFrame, key: str, dim: str) -> DataFrame:
    """(key, v): the values of a dimension, each in a struct, so that an absent one counts as a value."""
    return rows.select(key, F.explode(dim).alias("x")).select(key, F.struct("x").alias("v"))


def atoms_of(cubes: DataFrame, dim: str) -> DataFrame:
    """(v, atom): the atom of each value of a dimension, both in a struct; ``cubes`` has a column ``cube``."""
    signed = _values(cubes, "cube", dim).groupBy("v").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("cube")), ","), 256).alias("sign"))
    least = signed.groupBy("sign").agg(F.min("v").alias("atom"))
    return signed.join(least, "sign").select("v", "atom")


def _replaced(rows: DataFrame, key: str, keep: list[str], dims: list[str], tables: dict[str, DataFrame], have: str, want: str) -> DataFrame:
    """``rows`` with the values of every dimension looked up in its table, from ``have`` to ``want``.

    Each dimension is looked up from ``rows`` itself, so the plan grows with the
    number of dimensions and not with a power of it; ``rows`` should be a written table.
    """
    out = rows.select(key, *keep)
    for d in dims:
        found = _values(rows, key, d).withColumnRenamed("v", have).join(tables[d], have)
        own = found.groupBy(key).agg(F.array_sort(F.collect_set(want)).alias("own"))
        out = out.join(own.select(key, F.col("own.x").alias(d)), key)
    return out.select(*keep, *dims)


def combine(how: str, a: DataFrame, b: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Cubes of the union, difference (``subtract``), intersection or symmetric difference of two sets of cubes.

    The tagged cubes, the atoms of each dimension, those of the result and its cubes are written once each, as all dimensions
    look into them.
    """
    dims = list(dims or a.columns)
    cubes = written(_tagged([a, b], dims), "tagged-cubes")
    tables = {d: written(atoms_of(cubes, d), f"atoms-of-dimension-{k}") for k, d in enumerate(dims)}
    small = written(_replaced(cubes, "cube", ["side"], dims, tables, "v", "atom"), "atom-cubes")
    sides = [compression.explode(small.where(F.col("side") == k).select(*dims)).distinct() for k in (0, 1)]
    functions = {
        "union": algebra.union, "subtract": algebra.subtract, "intersect": algebra.intersect, "symmetric_difference": algebra.symmetric_difference,
    }
    rows = written(functions[how](*sides), "atoms")
    out = compression.cubes(rows, dims).withColumn("row", F.sha2(F.to_json(F.struct(*dims)), 256))
    return _replaced(written(out, "cubes-of-atoms"), "row", [], dims, tables, "atom", "v")


def count(cubes: DataFrame) -> DataFrame:
    """(identifiers): number of identifiers of disjoint cubes, as a decimal that can't overflow."""
    n = reduce(lambda x, y: x * y, [F.size(d).cast("decimal(19,0)") for d in cubes.columns])
    return cubes.agg(F.coalesce(F.sum(n.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("identifiers"))

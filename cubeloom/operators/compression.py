"""Lossless canonical compression of identifiers to a tree of dense cubes.

For the dimension order ``d1 .. dn``, deepest first: values of ``dn`` are
gathered for each prefix; then siblings with equal subtrees are merged, level
by level, where a subtree is named by a SHA-256 over its merged children.  Each
level costs two aggregates on shrinking inputs, both with map-side combining.
Distinct subtrees are kept once by name; cubes are read off by joining the
levels on those names.  Siblings never share a value, and the cubes' sizes add
up to the number of identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _name(c: Column) -> Column:
    return F.sha2(F.to_json(c), 256)


def _value_set(dim: str) -> Column:
    # within a struct an absent value counts as one
    return F.array_sort(F.collect_set(F.struct(F.col(dim).alias("v")))).alias("vs")


def levels(ids: DataFrame, dims: list[str] | None = None) -> list[DataFrame]:
    """For each dimension (name, vs, sub): the children that the subtree ``name`` has, each with the name of its own subtree.

    Level 0 has the children of the root and no name; the deepest has no sub.
    """
    dims = list(dims or ids.columns)
    rows = ids.select(*dims)
    out: list[DataFrame] = []
    for k in range(len(dims) - 1, -1, -1):
        prefix, leaf = dims[:k], k == len(dims) - 1
        keys = prefix if leaf else [*prefix, "sub"]
        kids = rows.groupBy(*keys).agg(_value_set(dims[k]))
        if leaf:
            kids = kids.withColumn("sub", F.lit(""))
        if k == 0:
            out.append(kids.where(F.size("vs") > 0).select(F.lit("").alias("name"), "vs", "sub"))
            break
        kids = kids.withColumn("kid", _name(F.struct("vs", "sub")))
        owners = kids.groupBy(*prefix).agg(F.array_sort(F.collect_list(F.struct("kid", "vs", "sub"))).alias("kids"))
        owners = owners.withColumn("name", _name(F.col("kids.kid")))
        out.append(owners.select("name", "kids").dropDuplicates(["name"]).select("name", F.inline("kids")).drop("kid"))
        rows = owners.select(*prefix, F.col("name").alias("sub"))
    return out[::-1]


def cubes(ids: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """One row for each cube, with an array of sorted values for each dimension (of one NULL where it is absent)."""
    dims = list(dims or ids.columns)
    out = None
    for d, level in zip(dims, levels(ids, dims), strict=True):
        level = level.select("name", F.col("vs.v").alias(d), "sub")
        out = level.drop("name") if out is None else out.withColumnRenamed("sub", "name").join(level, "name").drop("name")
    return out.select(*dims)


def leaf_cubes(ids: DataFrame, dims: list[str], source: str) -> DataFrame:
    """As ``cubes``, merging only leaves with equal ``source``, which comes as a last column.

    Provenance is part of the identity of a leaf, so that it is never blurred by merging.
    """
    tagged = ids.groupBy(*dims).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias(source))
    return cubes(tagged, [source, *dims]).select(*dims, F.col(source)[0].alias(source))


def size(cube: list[str]) -> Column:
    """Number of identifiers of a row of :func:`cubes`."""
    out = F.lit(1).cast("long")
    for d in cube:
        out = out * F.size(d)
    return out


def explode(cube_rows: DataFrame) -> DataFrame:
    """The identifiers of cubes."""
    out = cube_rows
    for d in cube_rows.columns:
        out = out.withColumn(d, F.explode(d))
    return out


def nodes(cube_rows: DataFrame) -> DataFrame:
    """(node_id, parent_id, depth, dim, coords, path): the tree below the root, absent dimensions skipped.

    An id is the SHA-256 of the path from the root, so it is the same in every run.
    """
    step = lambda d: F.struct(F.lit(d).alias("dim"), F.transform(d, lambda v: v.cast("string")).alias("coords"))
    path = F.array(*[F.when(F.exists(d, lambda v: v.isNotNull()), step(d)) for d in cube_rows.columns])
    rows = cube_rows.select(F.array_compact(path).alias("whole"))
    rows = rows.select("whole", F.explode(F.sequence(F.lit(1), F.size("whole"))).alias("depth"))
    rows = rows.select(F.slice("whole", 1, F.col("depth")).alias("path"), "depth").distinct()
    root = F.sha2(F.lit("root"), 256)
    parent = F.when(F.col("depth") == 1, root).otherwise(_name(F.slice("path", 1, F.col("depth") - 1)))
    last = F.element_at("path", -1)
    return rows.select(_name(F.col("path")).alias("node_id"), parent.alias("parent_id"), "depth", last["dim"].alias("dim"), last["coords"].alias("coords"), "path")


def structure_groups(ids: DataFrame, dims: list[str]) -> DataFrame:
    """(owner values, name): the subtree name below each value of the first dimension."""
    first, rest = dims[0], dims[1:]
    rows = ids.select(*dims).distinct()
    for k in range(len(rest) - 1, -1, -1):
        prefix = [first, *rest[:k]]
        keys = prefix if k == len(rest) - 1 else [*prefix, "sub"]
        kids = rows.groupBy(*keys).agg(_value_set(rest[k]))
        kids = kids if "sub" in kids.columns else kids.withColumn("sub", F.lit(""))
        kids = kids.withColumn("kid", _name(F.struct("vs", "sub")))
        rows = kids.groupBy(*prefix).agg(_name(F.array_sort(F.collect_list("kid"))).alias("sub"))
    return rows.select(first, F.col("sub").alias("name"))

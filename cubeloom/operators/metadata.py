"""Provenance: values of a key that hold for an identifier or for all identifiers below a prefix.

A metadata table is ``(dims..., key string, vals array<string>)``: a row holds
for the identifiers that equal it up to its last non-NULL dimension (all NULL:
for the whole set), and a longer prefix overrides a shorter one.  The truth is
kept by identifier; where a value is shown in the tree is derived from it.
Values by coordinate (``array<array<string>>``) belong to one value each of the
dimension of their node; by identifier they are plain values again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def depth_of(dims: list[str]) -> Column:
    """The length of a row's prefix: the place of its last dimension that is not NULL."""
    places = [F.when(F.col(d).isNotNull(), F.lit(k)).otherwise(F.lit(0)) for k, d in enumerate(dims, 1)]
    return F.greatest(F.lit(0), F.lit(0), *places)


def _same(dims: list[str], prefix: str) -> Column:
    """Null-safe equality of columns with those of the same names after ``prefix``; an equi-join for Spark."""
    return reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"{prefix}{d}")) for d in dims], F.lit(True))


def table(rows: DataFrame, dims: list[str], key: str, vals: Column) -> DataFrame:
    """A metadata table from rows that have the dimensions and a value set."""
    return rows.select(*dims, F.lit(key).alias("key"), value_set(vals).alias("vals")).distinct()


def put(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert; an empty value set clears its key at its prefix."""
    dims = [c for c in meta.columns if c not in ("key", "vals")]
    keys = new.select(*[F.col(c).alias(f"n {c}") for c in [*dims, "key"]])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"n {c}")) for c in [*dims, "key"]])
    return meta.join(keys, same, "left_anti").unionByName(new).where(F.size("vals") > 0)


def clear_path(meta: DataFrame, path: dict, key: str) -> DataFrame:
    """Drop a key at a prefix and at all prefixes of it."""
    dims = [c for c in meta.columns if c not in ("key", "vals")]
    on = F.col("key") == key
    for d in dims:
        on &= F.col(d).isNull() | F.col(d).eqNullSafe(F.lit(path[d])) if d in path else F.col(d).isNull()
    return meta.where(~on)


def _prefixes(rows: DataFrame, dims: list[str], *others: str) -> DataFrame:
    """(k, p <dim>..., others...): every row with each of its prefixes of ``k`` dimensions, NULL beyond."""
    lengths = F.array(*[F.lit(k) for k in range(len(dims) + 1)])
    out = rows.select(*dims, *others, F.explode(lengths).alias("k"))
    return out.withColumns({f"p {d}": F.when(F.col("k") > k, F.col(d)) for k, d in enumerate(dims)})


def _of_prefixes(ids: DataFrame, meta: DataFrame, dims: list[str]) -> DataFrame:
    """(dims..., key, vals, depth): for every identifier the values at each of its prefixes.

    Each identifier is sent once with all its prefixes and joined once; Spark
    broadcasts the table only if its size allows.
    """
    part = meta.select(*[F.col(d).alias(f"m {d}") for d in dims], "key", "vals", depth_of(dims).alias("depth"))
    on = reduce(lambda a, b: a & b, [F.col(f"p {d}").eqNullSafe(F.col(f"m {d}")) for d in dims], F.col("k") == F.col("depth"))
    return _prefixes(ids, dims).join(part, on).select(*dims, "key", "vals", "depth")


def resolve(ids: DataFrame, meta: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """(dims..., key, vals): for every identifier and key the value of the longest prefix that has it."""
    dims = list(dims or ids.columns)
    return _of_prefixes(ids, meta, dims).groupBy(*dims, "key").agg(F.max_by("vals", "depth").alias("vals"))


def push(ids: DataFrame, meta: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """(dims..., key, vals): for every identifier and key the union of the value sets of all prefixes that have it."""
    dims = list(dims or ids.columns)
    return _of_prefixes(ids, meta, dims).groupBy(*dims, "key").agg(value_set(F.flatten(F.collect_list("vals"))).alias("vals"))


def get(ids: DataFrame, meta: DataFrame, path: dict, key: str) -> DataFrame:
    """(vals): the value at a path, from its nearest ancestor; no row if there is none."""
    dims = [c for c in meta.columns if c not in ("key", "vals")]
    on = F.col("key") == key
    for d in dims:
        on &= F.col(d).isNull() | (F.col(d) == F.lit(path[d])) if d in path else F.col(d).isNull()
    return meta.where(on).agg(F.max_by("vals", depth_of(dims)).alias("vals")).where("vals is not null")


def at_node(meta: DataFrame, path: dict) -> DataFrame:
    """(key, vals): all keys at a path, children before ancestors."""
    dims = [c for c in meta.columns if c not in ("key", "vals")]
    on = F.lit(True)
    for d in dims:
        on &= F.col(d).isNull() | (F.col(d) == F.lit(path[d])) if d in path else F.col(d).isNull()
    return meta.where(on).groupBy("key").agg(F.max_by("vals", depth_of(dims)).alias("vals"))


def _agreed(resolved: DataFrame, ids: DataFrame, dims: list[str]) -> DataFrame:
    """(k, dims..., key, vals): prefixes of ``k`` dimensions of which all identifiers have equal values of a key."""
    prefix, text = [f"p {d}" for d in dims], F.to_json(F.struct("vals"))
    total = _prefixes(ids, dims).groupBy("k", *prefix).agg(F.count(F.lit(1)).alias("all"))
    total = total.select(F.col("k").alias("t k"), *[F.col(c).alias(f"t {c}") for c in prefix], "all")
    found = _prefixes(resolved, dims, "key", "vals").groupBy("k", *prefix, "key")
    found = found.agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.count(F.lit(1)).alias("n"), F.first("vals").alias("vals"))
    joined = found.where("lo = hi").join(total, _same(["k", *prefix], "t ") & (F.col("n") == F.col("all")))
    return joined.select("k", *[F.col(f"p {d}").alias(d) for d in dims], "key", "vals")


def consolidate(resolved: DataFrame, dims: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Shortest prefixes below which all identifiers agree on a key: the placement of a value in the tree.

    ``resolved`` has a value for every identifier that has the key; ``ids`` are
    all identifiers (else those that have any key).  All prefixes are counted in
    one aggregate each; a prefix whose parent agrees too is left out, which one
    join finds, as agreement goes down.  A prefix agrees only if none of its
    identifiers lacks the key.
    """
    ids = (resolved if ids is None else ids).select(*dims).distinct()
    # a prefix that ends in NULL can't be told from a shorter one: its values are placed below it
    agreed = _agreed(resolved, ids, dims).where(F.col("k") == depth_of(dims))
    up = F.greatest(F.lit(0), F.lit(0), *[F.when((F.col("k") > k) & F.col(d).isNotNull(), F.lit(k)).otherwise(F.lit(0)) for k, d in enumerate(dims, 1)])
    upper = agreed.select(*[F.col(c).alias(f"u {c}") for c in ("k", *dims, "key")])
    same = [F.when(F.col("up") > k, F.col(d)).eqNullSafe(F.col(f"u {d}")) for k, d in enumerate(dims)]
    on = reduce(lambda a, b: a & b, same, (F.col("up") == F.col("u k")) & (F.col("key") == F.col("u key")))
    return agreed.withColumn("up", F.when(F.col("k") > 0, up)).join(upper, on, "left_anti").select(*dims, "key", "vals")


def of_nodes(nodes: DataFrame, resolved: DataFrame, ids: DataFrame, dims: list[str]) -> DataFrame:
    """(node_id, key, vals): values that all identifiers below a node of the tree of ``ids`` agree on."""
    step = lambda d: F.filter("path", lambda p: p["dim"] == d)
    own = nodes.select("node_id", F.array_position(F.array(*map(F.lit, dims)), F.col("dim")).cast("int").alias("n k"), *[
        F.when(F.size(step(d)) > 0, F.get(step(d), F.lit(0))["coords"]).otherwise(F.array(F.lit(None).cast("string"))).alias(f"n {d}") for d in dims
    ])
    for d in dims:
        own = own.withColumn(f"n {d}", F.explode(f"n {d}"))
    size = own.groupBy("node_id").agg(F.count(F.lit(1)).alias("all"))
    agreed = _agreed(resolved, ids.select(*dims).distinct(), dims)
    same = reduce(lambda a, b: a & b, [F.col(d).cast("string").eqNullSafe(F.col(f"n {d}")) for d in dims], F.col("k") == F.col("n k"))
    text = F.to_json(F.struct("vals"))
    rows = own.join(agreed, same).groupBy("node_id", "key").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.count(F.lit(1)).alias("n"), F.first("vals").alias("vals"))
    return rows.where("lo = hi").join(size, "node_id").where("n = `all`").select("node_id", "key", "vals")


def unite(resolved: list[DataFrame], dims: list[str]) -> DataFrame:
    """Values of several sets by identifier, united where more than one has the identifier; absent dimensions are NULL."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), resolved)
    return every.groupBy(*dims, "key").agg(value_set(F.flatten(F.collect_list("vals"))).alias("vals"))


def of(resolved: DataFrame, ids: DataFrame, dims: list[str]) -> DataFrame:
    """The rows of ``resolved`` of the identifiers in ``ids``."""
    keys = ids.select(*[F.col(d).alias(f"i {d}") for d in dims]).distinct()
    return resolved.join(keys, _same(dims, "i "), "left_semi")


def deduplicate(meta: DataFrame, dims: list[str]) -> DataFrame:
    """Drop values that equal what their prefix inherits anyway."""
    depth = depth_of(dims)
    own = meta.withColumn("depth", depth)
    inherited = []
    for k in range(len(dims)):
        part = own.where(F.col("depth") == k).select(*[F.col(c).alias(f"u {c}") for c in [*dims[:k], "key", "vals"]])
        on = _same([*dims[:k], "key"], "u ")
        inherited.append(own.where(F.col("depth") > k).join(part, on).select(*own.columns, "u vals", F.lit(k).alias("u depth")))
    if not inherited:
        return meta
    near = reduce(DataFrame.unionByName, inherited).groupBy(*dims, "key").agg(F.max_by("u vals", "u depth").alias("inherited"))
    near = near.select(*[F.col(c).alias(f"n {c}") for c in [*dims, "key"]], "inherited")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"n {c}")) for c in [*dims, "key"]])
    joined = own.join(near, same, "left").where(F.col("inherited").isNull() | (F.col("vals") != F.col("inherited")))
    return joined.select(*meta.columns)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of the value sets of two metadata tables, by prefix and key."""
    dims = [c for c in a.columns if c != "vals"]
    return a.unionByName(b).groupBy(*dims).agg(value_set(F.flatten(F.collect_list("vals"))).alias("vals"))


def merge_values(a: Column, b: Column) -> Column:
    return value_set(F.concat(a, b))


def merge_per_coord(a: Column, b: Column) -> Column:
    """Lists by coordinate, united one by one; where their numbers differ, those of ``a``."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, merge_values)).otherwise(a)


def per_coord_at(coords: Column, per_coord: Column, value: Column) -> Column:
    """The values of one coordinate of a sorted set; null if it isn't there."""
    return F.get(per_coord, (F.nullif(F.array_position(coords, value), F.lit(0)) - 1).cast("int"))


def is_uniform(vals: Column) -> Column:
    return F.size(vals) == 1


def contains(vals: Column, value: Column) -> Column:
    return F.array_contains(vals, value.cast("string"))


def partition(resolved: DataFrame, key: str) -> DataFrame:
    """(value, dims...): the identifiers of each value of a key; those without it are left out."""
    return resolved.where(F.col("key") == key).select(F.explode("vals").alias("value"), *[c for c in resolved.columns if c not in ("key", "vals")]).distinct()


def pair(coords: Column, vals: Column, per_coord: Column | None = None) -> Column:
    """``array<struct<coord, value>>``: lists for each coordinate are zipped, one value goes to all, as many values as
    coordinates are zipped in order, and any other number goes to every coordinate."""
    each = lambda c, vs: F.transform(vs, lambda v: F.struct(c.cast("string").alias("coord"), v.alias("value")))
    product = F.flatten(F.transform(coords, lambda c: each(c, vals)))
    zipped = F.zip_with(coords, vals, lambda c, v: F.struct(c.cast("string").alias("coord"), v.alias("value")))
    out = F.when((F.size(vals) == F.size(coords)) & (F.size(vals) > 1), zipped).otherwise(product)
    if per_coord is None:
        return out
    return F.when(F.size(per_coord) == F.size(coords), F.flatten(F.zip_with(coords, per_coord, each))).otherwise(out)


def per_coord_json(per_coord: Column) -> Column:
    return F.to_json(F.struct(per_coord.alias("per_coord_strings")))


def per_coord_from_json(text: Column) -> Column:
    return F.from_json(text, "struct<per_coord_strings:array<array<string>>>")["per_coord_strings"]


def to_json(vals: Column) -> Column:
    """Integers as ``{"ints": []}`` where all values are whole numbers, else ``{"strings": []}``."""
    whole = F.forall(vals, lambda v: v.rlike(r"^(0|-?[1-9][0-9]{0,8})$")) & (F.size(vals) > 0)
    ints = F.to_json(F.struct(F.array_sort(F.transform(vals, lambda v: v.try_cast("int"))).alias("ints")))
    return F.when(whole, ints).otherwise(F.to_json(F.struct(vals.alias("strings"))))


def from_json(text: Column) -> Column:
    """All values of a document; those by coordinate as one set, see :func:`per_coord_from_json`."""
    got = F.from_json(text, "struct<ints:array<int>,strings:array<string>,per_coord_strings:array<array<string>>>")
    return F.coalesce(F.transform(got["ints"], lambda v: v.cast("string")), got["strings"], F.flatten(got["per_coord_strings"]))

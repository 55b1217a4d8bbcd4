"""Set algebra on wide identifier tables: one column for each dimension, NULL where an identifier lacks it.

Every operator is a declarative plan of a few DataFrame steps; nothing is
collected but what a caller must know to build a plan (which dimensions have a
single value, for ``squeeze``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Values = Iterable


def identifiers(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.select(*dims).distinct()


def _and(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _values(given) -> list:
    return list(given) if isinstance(given, list | tuple | set | frozenset) else [given]


# filters


def select(ids: DataFrame, request: Mapping[str, Values], mode: str = "default") -> DataFrame:
    """Identifiers whose value is asked for in every selected dimension that they have; mode ``prune`` wants them to have all."""
    absent = [d for d in request if d not in ids.columns]
    if absent and mode == "prune":
        return ids.where(F.lit(False))
    tests = {d: F.col(d).isin(_values(v)) for d, v in request.items() if d in ids.columns}
    return ids.where(_and(t if mode == "prune" else F.col(d).isNull() | t for d, t in tests.items()))


def prune(ids: DataFrame, dims: Iterable[str]) -> DataFrame:
    """Identifiers that have all the dimensions."""
    return ids.where(_and(F.col(d).isNotNull() if d in ids.columns else F.lit(False) for d in dims))


# projections


def drop(ids: DataFrame, dims: Iterable[str]) -> DataFrame:
    gone = [d for d in dims if d in ids.columns]
    return ids.drop(*gone).distinct() if gone else ids


def collapse(ids: DataFrame, axis: str | Iterable[str]) -> DataFrame:
    names = [axis] if isinstance(axis, str) else list(axis)
    if not all(isinstance(n, str) for n in names):
        raise TypeError("dimensions are named by strings")
    if missing := sorted(set(names) - set(ids.columns)):
        raise ValueError(f"no such dimension: {', '.join(missing)}")
    return drop(ids, names)


def single_valued(ids: DataFrame) -> list[str]:
    """Dimensions with one value over all identifiers that have them."""
    row = ids.agg(*[F.min(d).eqNullSafe(F.max(d)).alias(d) for d in ids.columns], *[F.max(d).isNotNull().alias(f"has {d}") for d in ids.columns]).first()
    return [d for d in ids.columns if row[d] and row[f"has {d}"]]


def squeeze(ids: DataFrame) -> DataFrame:
    return drop(ids, single_valued(ids))


def _with_values(ids: DataFrame, dim: str, values: Values) -> DataFrame:
    lits = F.array(*map(F.lit, _values(values)))
    return ids.select(F.explode(F.array_distinct(lits)).alias(dim), *[c for c in ids.columns if c != dim])


def expand(ids: DataFrame, request: Mapping[str, Values]) -> DataFrame:
    """Every identifier with every combination of the values; the last dimension given comes outermost.

    A literal array is exploded row by row, so nothing is joined or shuffled.
    """
    return reduce(lambda out, d: _with_values(out, d, request[d]), request, ids)


def prepend(ids: DataFrame, request: Mapping[str, Values], order: list[str] | None = None) -> DataFrame:
    """As ``expand``, with the first dimension (of ``order``) outermost; dimensions that an order leaves out are ignored."""
    names = [d for d in (order if order is not None else request) if d in request]
    return expand(ids, {d: request[d] for d in reversed(names)})


def coxpand(ids: DataFrame, axis: str | Iterable[str], request: Mapping[str, Values]) -> DataFrame:
    return expand(collapse(ids, axis), request)


# set operations


def without_prefixes(ids: DataFrame) -> DataFrame:
    """The distinct identifiers, without those that another one extends.

    Every row goes with its own length and as each of its prefixes into one
    aggregate, which has local pre-aggregation; a prefix that is only an
    identifier of its own stays.
    """
    dims = ids.columns
    depth = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col(d).isNotNull(), F.lit(k)).otherwise(F.lit(0)) for k, d in enumerate(dims, 1)])
    rows = ids.withColumn("depth of row", depth)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("depth of row"))))
    prefix = [F.when(F.col("k") >= k, F.col(d)).alias(d) for k, d in enumerate(dims, 1)]
    rows = rows.select("k", *prefix, (F.col("k") < F.col("depth of row")).alias("longer"))
    return rows.groupBy("k", *dims).agg(F.bool_or("longer").alias("longer")).where("not longer").select(*dims)


def union(*sets: DataFrame, absorb: bool = False) -> DataFrame:
    """Union of any number of sets in one aggregate; ``absorb`` drops identifiers that others extend."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    return without_prefixes(out) if absorb else out.distinct()


def _same_dims(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    dims = [*a.columns, *[c for c in b.columns if c not in a.columns]]
    kinds = dict(b.dtypes) | dict(a.dtypes)
    wide = lambda x: x.select(*[x[d] if d in x.columns else F.lit(None).cast(kinds[d]).alias(d) for d in dims])
    return wide(a), wide(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Identifiers of ``a`` that ``b`` doesn't have."""
    wide, other = _same_dims(a, b)
    return wide.subtract(other).select(*a.columns)


def subtract_prefix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Identifiers of ``a`` that neither are in ``b`` nor extend an identifier of ``b``.

    ``b`` may have fewer leading dimensions, or NULL at the end: one anti-join
    for each length that occurs in its columns.
    """
    dims = a.columns
    b = b.select(*[d for d in dims if d in b.columns])
    for k in range(1, len(b.columns) + 1):
        own = dims[:k]
        if b.columns[:k] != own:
            break
        part = b.where(F.col(own[-1]).isNotNull() & _and(F.col(d).isNull() for d in b.columns[k:]))
        part = part.select(*[F.col(d).alias(f"b {d}") for d in own]).distinct()
        a = a.join(part, _and(F.col(d).eqNullSafe(F.col(f"b {d}")) for d in own), "left_anti")
    return a


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    wide, other = _same_dims(a, b)
    return wide.intersect(other)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Identifiers of just one of two sets, in a single aggregate."""
    wide, other = _same_dims(a, b)
    both = wide.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(2)))
    return both.groupBy(*wide.columns).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi").drop("lo", "hi")


# summaries


def long_form(ids: DataFrame) -> DataFrame:
    """(dim, value) with values as text, NULLs left out; one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in ids.columns])
    return ids.select(F.inline(pairs)).where("value is not null")


def axes(ids: DataFrame) -> DataFrame:
    """(dim, value): the values of each dimension."""
    return long_form(ids).distinct()


def dimensions(ids: DataFrame) -> DataFrame:
    return long_form(ids).select("dim").distinct()


def common_dimensions(ids: DataFrame) -> DataFrame:
    """(dim): dimensions that every identifier has; none for an empty set."""
    counts = ids.agg(F.count(F.lit(1)).alias("all"), *[F.count(d).alias(d) for d in ids.columns])
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("n")) for d in ids.columns])
    return counts.select("all", F.inline(pairs)).where("n = `all` and n > 0").select("dim")


def contains_dim(ids: DataFrame, dim: str) -> DataFrame:
    test = F.coalesce(F.bool_or(F.col(dim).isNotNull()), F.lit(False)) if dim in ids.columns else F.lit(False)
    return ids.agg(test.alias("contained"))


def contains_values(ids: DataFrame, request: Mapping[str, Values]) -> DataFrame:
    """Whether every value occurs in its dimension, compared as text."""
    tests = [F.lit(True)]
    for d, given in request.items():
        for v in _values(given):
            tests.append(F.coalesce(F.bool_or(F.col(d).cast("string") == F.lit(str(v))), F.lit(False)) if d in ids.columns else F.lit(False))
    return ids.agg(_and(tests).alias("contained"))


def contains_set(ids: DataFrame, other: DataFrame) -> DataFrame:
    """Whether each dimension of ``other`` has no value that ``ids`` lacks there (by dimension, not by identifier)."""
    lacking = axes(other).join(axes(ids), ["dim", "value"], "left_anti")
    return lacking.agg((F.count(F.lit(1)) == 0).alias("contained"))

"""``CubeSet``: an immutable, lazy handle on a set of identifiers, its dimension order and its provenance.

Operators only build plans.  Compression, counts and the text and JSON forms
run when asked for; what they bring to the driver is a compressed tree.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.operators import algebra, compression, metadata, navigation
from cubeloom.operators.materialise import written
from cubeloom.sources import json_forms, tables, text
from cubeloom.sources.tree import Tree, by_coordinate, from_cubes, hoist, provenance, to_frame


def _order(new: list[str], dims: Iterable[str]) -> list[str]:
    return [*new, *[d for d in dims if d not in new]]


class CubeSet:
    """Provenance is kept as a metadata table (``meta``) or by identifier (``resolved``), whichever came last; the other
    is derived when it is asked for."""

    def __init__(self, ids: DataFrame, dims: list[str] | None = None, meta: DataFrame | None = None, resolved: DataFrame | None = None):
        self.dims = list(dims or ids.columns)
        self.ids = ids.select(*self.dims)
        self._meta = meta
        self._resolved = resolved

    def clone(self) -> CubeSet:
        """Another handle on the same set; sets never change, so nothing is copied."""
        return CubeSet(self.ids, self.dims, self._meta, self._resolved)

    clone_qube = __copy__ = clone

    def __deepcopy__(self, memo: dict) -> CubeSet:
        return self.clone()

    # constructors

    @classmethod
    def empty(cls, spark: SparkSession, dims: list[str] | None = None) -> CubeSet:
        return cls(spark.createDataFrame([], ", ".join(f"`{d}` string" for d in dims or ["none"])))

    @classmethod
    def from_tree(cls, spark: SparkSession, tree: Tree) -> CubeSet:
        """Nodes keep their values: as a metadata table, or by identifier where branches differ in the order of dimensions."""
        if not tree.children:
            return cls.empty(spark)
        dims = tree.dims()
        found = provenance(spark, tree, dims)
        meta, in_order = found or (None, True)
        return cls(to_frame(spark, tree, dims), dims, meta if in_order else None, None if in_order else meta)

    @classmethod
    def from_ascii(cls, spark: SparkSession, doc: str) -> CubeSet:
        try:
            return cls.from_tree(spark, text.parse_ascii(doc))
        except ValueError as e:
            raise TypeError(str(e)) from e

    @classmethod
    def from_json(cls, spark: SparkSession, doc: Any) -> CubeSet:
        return cls.from_tree(spark, json_forms.from_nested(doc))

    @classmethod
    def from_arena_json(cls, spark: SparkSession, doc: Any) -> CubeSet:
        return cls.from_tree(spark, json_forms.from_arena(doc))

    @classmethod
    def from_tree_json(cls, spark: SparkSession, doc: Any) -> CubeSet:
        return cls.from_tree(spark, json_forms.from_tree_json(doc))

    @classmethod
    def from_datacube(cls, spark: SparkSession, cube: dict, order: list[str] | None = None) -> CubeSet:
        return cls.from_tree(spark, json_forms.from_datacube(cube, order))

    @classmethod
    def from_listing(cls, spark: SparkSession, doc: str) -> CubeSet:
        return cls.from_tree(spark, text.parse_listing(doc))

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: list[str]) -> CubeSet:
        dims = list(dict.fromkeys(p.partition("=")[0].strip() for x in paths for p in x.split(",") if "=" in p))
        return cls(text.read_path_list(spark.createDataFrame([(p,) for p in paths], "value string"), dims))

    @classmethod
    def from_constraints(cls, spark: SparkSession, path: str, dims: list[str] | None = None) -> CubeSet:
        return cls(compression.explode(tables.read_constraints(spark, path, dims)).distinct())

    @classmethod
    def from_table(cls, spark: SparkSession, path: str, dims: list[str]) -> CubeSet:
        return cls(tables.scan(spark, path, dims))

    def _like(self, ids: DataFrame, dims: list[str] | None = None) -> CubeSet:
        """A part of this set; further dimensions are NULL in it."""
        dims = list(dims or ids.columns)
        wide = lambda t: t and self._wide(t, dims, dict(ids.dtypes))
        return CubeSet(ids, dims, wide(self._meta), wide(self._resolved))

    @staticmethod
    def _wide(table: DataFrame, dims: list[str], kinds: dict[str, str]) -> DataFrame:
        return table.select(*[F.col(d) if d in table.columns else F.lit(None).cast(kinds[d]).alias(d) for d in dims], "key", "vals")

    def has_metadata(self) -> bool:
        """Whether any values were given; reads nothing."""
        return self._meta is not None or self._resolved is not None

    def _united(self, ids: DataFrame, dims: list[str], others: Iterable[CubeSet]) -> CubeSet:
        """``ids`` with the values that this and other sets have for them, united by identifier.

        Values of identifiers that are not in ``ids`` are left out when they are resolved.
        """
        known = [s.resolve() for s in (self, *others) if s.has_metadata()]
        if not known:
            return CubeSet(ids, dims)
        kinds = dict(ids.dtypes)
        return CubeSet(ids, dims, None, metadata.unite([self._wide(r, dims, kinds) for r in known], dims))

    # algebra

    def union(self, *others: CubeSet) -> CubeSet:
        """Identifiers of any of the sets.  Values are united by identifier: one that only one set has keeps just its own.

        An identifier that another one extends is absorbed, and its values go with it.
        """
        dims = self.dims
        for o in others:
            dims = _order(dims, o.dims)
        ids = algebra.union(self.ids, *[o.ids for o in others], absorb=True).select(*dims)
        return self._united(ids, dims, others)

    append = __or__ = union

    def append_many(self, others: Iterable[CubeSet]) -> CubeSet:
        others = list(others)
        if not all(isinstance(o, CubeSet) for o in others):
            raise TypeError("only sets can be appended")
        return self.union(*others)

    def append_datacube(self, cube: dict, order: list[str] | None = None) -> CubeSet:
        return self.union(CubeSet.from_datacube(self.ids.sparkSession, cube, order))

    def subtract(self, other: CubeSet) -> CubeSet:
        return self._like(algebra.subtract_prefix(self.ids, other.ids) if other.dims == self.dims[: len(other.dims)] else algebra.subtract(self.ids, other.ids))

    __sub__ = subtract

    def intersect(self, other: CubeSet) -> CubeSet:
        ids = algebra.intersect(self.ids, other.ids)
        return self._united(ids, ids.columns, [other])

    __and__ = intersect

    def symmetric_difference(self, other: CubeSet) -> CubeSet:
        ids = algebra.symmetric_difference(self.ids, other.ids)
        return self._united(ids, ids.columns, [other])

    __xor__ = symmetric_difference

    def select(self, request: Mapping[str, Any], mode: str | None = None) -> CubeSet:
        return self._like(algebra.select(self.ids, request, "prune" if mode == "prune" else "default"))

    def prune(self, dims: Iterable[str]) -> CubeSet:
        return self._like(algebra.prune(self.ids, dims))

    def _fewer(self, ids: DataFrame) -> CubeSet:
        """After dropping dimensions: an identifier has the values of all that became it."""
        if not self.has_metadata():
            return CubeSet(ids)
        left = self.resolve().select(*ids.columns, "key", "vals")
        return CubeSet(ids, ids.columns, None, metadata.unite([left], ids.columns))

    def drop(self, dims: Iterable[str]) -> CubeSet:
        return self._fewer(algebra.drop(self.ids, dims))

    def squeeze(self) -> CubeSet:
        return self._fewer(algebra.squeeze(self.ids))

    def collapse(self, axis: str | list[str]) -> CubeSet:
        return self._fewer(algebra.collapse(self.ids, axis))

    def _more(self, ids: DataFrame, request: Mapping[str, Any]) -> CubeSet:
        """After adding dimensions outermost: every identifier that one became has its values."""
        wide = lambda t: t and algebra.expand(t, request).select(*ids.columns, "key", "vals")
        return CubeSet(ids, ids.columns, wide(self._meta), wide(self._resolved))

    def expand(self, request: Mapping[str, Any]) -> CubeSet:
        return self._more(algebra.expand(self.ids, request), request)

    def prepend(self, request: Mapping[str, Any], order: list[str] | None = None) -> CubeSet:
        ids = algebra.prepend(self.ids, request, order)
        return self._more(ids, {d: request[d] for d in reversed(ids.columns) if d in request and (d not in self.dims or order is None or d in order)})

    def coxpand(self, axis: str | list[str], request: Mapping[str, Any]) -> CubeSet:
        return self.collapse(axis).expand(request)

    # summaries

    def axes(self) -> dict[str, list[str]]:
        rows = algebra.axes(self.ids).groupBy("dim").agg(F.array_sort(F.collect_set("value")).alias("v")).collect()
        return {r["dim"]: r["v"] for r in sorted(rows)}

    all_unique_dim_coords = axes

    def dimensions(self) -> set[str]:
        return {r["dim"] for r in algebra.dimensions(self.ids).collect()}

    def common_dimensions(self) -> set[str]:
        return {r["dim"] for r in algebra.common_dimensions(self.ids).collect()}

    def contains(self, what: str | Mapping[str, Any] | CubeSet) -> bool:
        if isinstance(what, str):
            found = algebra.contains_dim(self.ids, what)
        elif isinstance(what, Mapping):
            found = algebra.contains_values(self.ids, what)
        elif isinstance(what, CubeSet):
            found = algebra.contains_set(self.ids, what.ids)
        else:
            raise TypeError("contains takes a dimension, values by dimension, or a set")
        return found.first()["contained"]

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def cubes(self) -> DataFrame:
        return compression.cubes(self.ids, self.dims)

    compress = cubes

    def nodes(self) -> DataFrame:
        return compression.nodes(self.cubes())

    def __len__(self) -> int:
        """Number of leaf paths of the compressed tree."""
        return self.cubes().count()

    datacube_count = __len__

    def identifier_count(self) -> int:
        return self.ids.distinct().count()

    # forms

    def tree(self, values: bool = False) -> Tree:
        """The compressed tree; with ``values``, leaves are as fine as provenance needs, and values stand as high as they can."""
        if not (values and self.has_metadata()):
            return from_cubes(self.cubes())
        source = "leaf values"
        pairs = F.to_json(F.array_sort(F.collect_list(F.struct("key", "vals")))).alias(source)
        tagged = self.resolve().groupBy(*self.dims).agg(pairs)
        tagged = tagged.select(*[F.col(d).alias(f"i {d}") for d in self.dims], source)
        same = functools.reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"i {d}")) for d in self.dims])
        ids = self.ids.distinct().join(tagged, same, "left").select(*self.dims, F.coalesce(source, F.lit("[]")).alias(source))
        tree = from_cubes(compression.cubes(ids, [*self.dims, source]), source)
        by_coordinate(tree)
        hoist(tree)
        return tree

    def to_ascii(self) -> str:
        return text.to_ascii(self.tree())

    __str__ = __repr__ = to_ascii

    def to_json(self) -> dict:
        return json_forms.to_nested(self.tree())

    def to_arena_json(self) -> dict:
        return json_forms.to_arena(self.tree(values=True))

    def to_tree_json(self) -> dict:
        return json_forms.to_tree_json(self.tree())

    def to_datacubes(self) -> list[dict]:
        return json_forms.to_datacubes(self.tree())

    def to_constraints(self) -> DataFrame:
        return tables.to_constraints(self.cubes())

    # provenance

    def meta(self) -> DataFrame:
        """The metadata table; from values by identifier, the shortest prefixes below which all agree."""
        if self._meta is None and self._resolved is not None:
            # written, as every level of the tree reads them
            self._meta = metadata.consolidate(written(self.resolve(), "provenance"), self.dims, written(self.ids.distinct(), "identifiers"))
        if self._meta is None:
            kinds = dict(self.ids.dtypes)
            schema = ", ".join(f"`{d}` {kinds[d]}" for d in self.dims)
            self._meta = self.ids.sparkSession.createDataFrame([], f"{schema}, key string, vals array<string>")
        return self._meta

    def set_metadata(self, path: Mapping[str, Any], key: str, values: list) -> CubeSet:
        """A new handle with values at a prefix; an empty list clears the key there and above."""
        meta = self.meta()
        if not values:
            return CubeSet(self.ids, self.dims, metadata.clear_path(meta, dict(path), key))
        kinds = dict(self.ids.dtypes)
        row = self.ids.sparkSession.range(1).select(
            *[F.lit(path.get(d)).cast(kinds[d]).alias(d) for d in self.dims],
            F.lit(key).alias("key"), metadata.value_set(F.array(*[F.lit(str(v)) for v in values])).alias("vals"),
        )
        return CubeSet(self.ids, self.dims, metadata.put(meta, row))

    def get_metadata(self, path: Mapping[str, Any], key: str) -> list[str] | None:
        row = metadata.get(self.ids, self.meta(), dict(path), key).first()
        return row and row["vals"]

    def get_all_metadata(self, path: Mapping[str, Any]) -> dict[str, list[str]]:
        return {r["key"]: r["vals"] for r in metadata.at_node(self.meta(), dict(path)).collect()}

    get_node_metadata = get_all_metadata

    def resolve(self) -> DataFrame:
        """(dims..., key, vals) by identifier."""
        if self._resolved is not None:
            return metadata.of(self._resolved, self.ids, self.dims)
        return metadata.resolve(self.ids.distinct(), self.meta(), self.dims)

    def partition_by_metadata(self, key: str) -> dict[str, CubeSet]:
        """A set for each value of a key; the values come to the driver, the sets stay lazy."""
        rows = metadata.partition(self.resolve(), key)
        values = [r["value"] for r in rows.select("value").distinct().collect()]
        return {v: CubeSet(rows.where(F.col("value") == v).drop("value"), self.dims) for v in sorted(values)}

    def node_metadata(self) -> DataFrame:
        """(node_id, key, vals): the values that all identifiers below a node of :meth:`nodes` agree on."""
        return metadata.of_nodes(self.nodes(), self.resolve(), self.ids, self.dims)

    def find(self, path: Mapping[str, Any]) -> DataFrame:
        return navigation.find(self.nodes(), dict(path))

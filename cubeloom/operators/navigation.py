"""Access to the node table of a tree: parents, children, ancestors, subtrees, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_text(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``path_text`` (``dim=a/b,dim=c``)."""
    step = lambda p: F.concat(p["dim"], F.lit("="), F.array_join(p["coords"], "/"))
    return nodes.withColumn("path_text", F.array_join(F.transform("path", step), ","))


def children(nodes: DataFrame, node_id: str, dim: str | None = None) -> DataFrame:
    out = nodes.where(F.col("parent_id") == node_id)
    return out if dim is None else out.where(F.col("dim") == dim)


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("p")).distinct(), F.col("node_id") == F.col("p"), "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor): prefixes of each node's path, by which an ancestor is named."""
    ups = F.when(F.col("depth") > 1, F.sequence(F.lit(1), F.col("depth") - 1))
    rows = nodes.select("node_id", "path", F.explode(ups).alias("k"))
    return rows.select("node_id", F.sha2(F.to_json(F.slice("path", 1, F.col("k"))), 256).alias("ancestor"))


def remove(nodes: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Without the nodes named in ``node_ids`` (node_id) and all below them."""
    gone = node_ids.select("node_id").distinct()
    below = ancestors(nodes).join(gone.withColumnRenamed("node_id", "g"), F.col("ancestor") == F.col("g"), "left_semi").select("node_id")
    return nodes.join(gone.unionByName(below), "node_id", "left_anti")


def span(nodes: DataFrame) -> DataFrame:
    """(node_id, dim): dimensions strictly below each node that has any."""
    up = ancestors(nodes).join(nodes.select("node_id", "dim"), "node_id")
    return up.select(F.col("ancestor").alias("node_id"), "dim").distinct()


def level_counts(nodes: DataFrame) -> DataFrame:
    """(dim, nodes, coords): numbers of nodes and of their values by dimension."""
    return nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.size("coords")).cast("long").alias("coords"))


def find(nodes: DataFrame, path: dict) -> DataFrame:
    """The node that a path of values leads to, compared as text, contiguous from the root; no row if there is none."""
    out = nodes.where(F.col("depth") == len(path))
    for k, (d, v) in enumerate(path.items()):
        step = F.col("path")[k]
        out = out.where((step["dim"] == d) & F.array_contains(step["coords"], str(v)))
    return out


def build(rows: DataFrame) -> DataFrame:
    """Child nodes from (parent_id, dim, coords): one for each parent, dimension and set of values."""
    sets = rows.withColumn("coords", F.array_sort(F.array_distinct("coords")))
    distinct = sets.select("parent_id", "dim", "coords").distinct()
    return distinct.withColumn("node_id", F.sha2(F.to_json(F.struct("parent_id", "dim", "coords")), 256))


def is_new(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(parent_id, dim, coords, is_new): whether a parent lacks a child with the dimension and set of values."""
    want = rows.select("parent_id", "dim", F.array_sort(F.array_distinct("coords")).alias("coords")).distinct()
    have = nodes.select("parent_id", "dim", F.array_sort("coords").alias("coords"), F.lit(False).alias("is_new")).distinct()
    return want.join(have, ["parent_id", "dim", "coords"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))


def has_leaf_content(nodes: DataFrame) -> DataFrame:
    """(node_id): nodes that are, or have below them, a leaf with values; ``nodes`` may hold nodes without any."""
    full = leaves(nodes).where(F.size("coords") > 0)
    ups = ancestors(full).select(F.col("ancestor").alias("node_id"))
    return full.select("node_id").unionByName(ups).distinct()

"""The text tree with box-drawing characters, and indented and comma-separated listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions import values as V
from cubeloom.sources.tree import Tree

_BRANCH = "├└│─  \t"
_UNIT = 4


def parse_ascii(text: str) -> Tree:
    """A tree drawn with four characters for each level; ``dim=a/b, dim=c`` on a line is a chain."""
    lines = [line for line in text.splitlines() if line.strip()]
    if not lines or lines[0].strip() != "root":
        raise ValueError("a drawn tree begins with the line 'root'")
    root = Tree()
    at: list[Tree] = [root]
    for line in lines[1:]:
        body = line.lstrip(_BRANCH)
        indent = len(line) - len(body)
        if indent % _UNIT:
            raise ValueError(f"indentation of {indent} is no multiple of {_UNIT}: {line!r}")
        level = indent // _UNIT
        if not 1 <= level <= len(at):
            raise ValueError(f"unexpected indentation: {line!r}")
        node = at[level - 1]
        for part in body.split(", "):
            dim, found, given = part.strip().partition("=")
            if not found:
                raise ValueError(f"no '=' in {line!r}")
            child = Tree(dim.strip(), V.from_text(given.strip()))
            node.children.append(child)
            node = child
        del at[level:]
        at.append(node)
    return root


def to_ascii(tree: Tree) -> str:
    out = ["root"]

    def walk(node: Tree, lead: str):
        for k, c in enumerate(node.children):
            end = k == len(node.children) - 1
            out.append(f"{lead}{'└' if end else '├'}── {c.dim}={'/'.join(map(V.text, c.coords))}")
            walk(c, lead + ("    " if end else "│   "))

    walk(tree, "")
    return "\n".join(out) + "\n"


def ascii_lines(nodes: DataFrame) -> DataFrame:
    """(depth, line): the drawn lines of a node table, indented by depth, made without collecting."""
    body = F.concat("dim", F.lit("="), F.array_join("coords", "/"))
    return nodes.select("depth", F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), body).alias("line"))


def parse_listing(text: str) -> Tree:
    """Lines ``a=0,b=1/2``: commas chain; a deeper line goes below the last node of the line above it.

    Tokens without ``=`` or without values are skipped.
    """
    root = Tree()
    stack: list[tuple[int, Tree]] = [(-1, root)]
    for line in text.splitlines():
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while stack[-1][0] >= indent:
            stack.pop()
        node = stack[-1][1]
        for part in line.split(","):
            dim, _, given = part.strip().partition("=")
            if coords := V.adapter_tokens(given):
                node = node.add(dim.strip(), coords)
        stack.append((indent, node))
    return root


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """(file, cube map<string, array<string>>): leaf cubes of listing files, each parsed in one task; a chain is cut nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, c) for f, t in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for c in parse_listing(t).paths()]
            maps = [[(d, [V.text(v) for v in vs]) for d, vs in c.items()] for _, c in rows]
            kind = pa.map_(pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array(maps, kind)], ["file", "cube"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInArrow(run, "file string, cube map<string,array<string>>")


def read_path_list(lines: DataFrame, dims: list[str], column: str = "value") -> DataFrame:
    """Identifiers of path strings ``class=od,expver=0001,param=1/2``; NULL where a path lacks a dimension or its value."""
    pairs = F.str_to_map(F.col(column), F.lit(","), F.lit("="))
    keys = F.transform_keys(pairs, lambda k, _: F.trim(k))
    out = lines.select(keys.alias("p"))
    for d in dims:
        tokens = F.filter(F.transform(F.split(F.element_at("p", F.lit(d)), "/"), lambda v: F.trim(v)), lambda v: v != "")
        out = out.withColumn(d, F.explode_outer(tokens))
    return out.select(*dims).distinct()

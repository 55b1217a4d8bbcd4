"""``python -m cubeloom.cli``: read a catalogue file and draw its tree, or scan tables by a configuration."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from cubeloom.plans.cubeset import CubeSet
from cubeloom.streaming import scanner

FORMS = ("listing", "paths", "constraints", "drawn", "nested", "arena", "tree")


def read(spark: SparkSession, form: str, path: str) -> CubeSet:
    """The set in a file of one of ``FORMS``."""
    if form == "constraints":
        return CubeSet.from_constraints(spark, path)
    doc = spark.read.text(path, wholetext=True).first()["value"]
    if form == "paths":
        return CubeSet.from_paths(spark, [line for line in doc.splitlines() if line.strip()])
    readers = {"listing": CubeSet.from_listing, "drawn": CubeSet.from_ascii, "nested": CubeSet.from_json, "arena": CubeSet.from_arena_json, "tree": CubeSet.from_tree_json}
    return readers[form](spark, doc)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cubeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    show = commands.add_parser("read", help="draw the tree of a catalogue file")
    show.add_argument("form", choices=FORMS)
    show.add_argument("path")
    scans = commands.add_parser("scan", help="scan a Parquet table by a configuration file")
    scans.add_argument("config")
    scans.add_argument("table")
    scans.add_argument("dims", help="comma-separated, outermost first")
    target = scans.add_mutually_exclusive_group(required=True)
    target.add_argument("--folder")
    target.add_argument("--store")
    scans.add_argument("--key", default="")
    scans.add_argument("--rounds", type=int)
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("cubeloom").getOrCreate()
    if given.command == "read":
        found = read(spark, given.form, given.path)
        print(found, end="")
        print(json.dumps({"cubes": len(found), "identifiers": found.identifier_count()}))
        return
    with open(given.config, encoding="utf-8") as f:
        config = scanner.Config.parse(f.read())
    sink = scanner.to_folder(spark, given.folder) if given.folder else scanner.to_store(given.store, given.key)
    scanner.run(spark, spark.read.parquet(given.table), config, given.dims.split(","), sink, rounds=given.rounds)


if __name__ == "__main__":
    main()

"""Sources and sinks of tables: constraints, index records, directory listings, identifier scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dimensions of constraint files, outermost first.
CONSTRAINT_DIMS = ["origin", "forecast_type", "product_type", "hday", "hmonth", "hyear", "year", "month", "leadtime_hour", "level_type", "day", "variable", "time"]
SPLIT_BY = ["stream", "type", "levtype", "time"]
NUMERIC = ["number", "step", "levelist"]


def scan(spark: SparkSession, path: str, dims: list[str]) -> DataFrame:
    """Distinct identifiers of a Parquet table; only the dimensions are read."""
    return spark.read.parquet(path).select(*dims).distinct()


def read_constraints(spark: SparkSession, path: str, dims: list[str] | None = None, lines: bool = False) -> DataFrame:
    """Cubes of a JSON array of ``{dim: [values]}``; an absent or empty dimension is an array of one NULL.

    A file with an array is read in one task; with ``lines``, one object stands on each line and files can be split.
    """
    dims = dims or CONSTRAINT_DIMS
    schema = ", ".join(f"`{d}` array<string>" for d in dims)
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return raw.select(*[F.when(F.size(F.col(f"`{d}`")) > 0, F.array_sort(F.array_distinct(d))).otherwise(F.array(F.lit(None).cast("string"))).alias(d) for d in dims])


def to_constraints(cubes: DataFrame) -> DataFrame:
    """(constraint): a JSON object for each cube with all dimensions as text values, ``[]`` where one is absent."""
    own = [F.filter(F.transform(d, lambda v: v.cast("string")), lambda v: v.isNotNull()).alias(d) for d in cubes.columns]
    return cubes.select(F.to_json(F.struct(*own)).alias("constraint"))


def excluded(type_: Column, levtype: Column, param: Column) -> Column:
    """Records that an index scan leaves out."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return no(type_.isin("em", "es", "ep")) | no(levtype == "sol") | no(param.isin("z", "sdor", "slor") & (levtype == "sfc"))


def read_index(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Index records (a JSON object on each line), as text, without excluded ones."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(path)
    get = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    return raw.where(~excluded(get("type"), get("levtype"), get("param")))


def group_records(records: DataFrame, split_by: list[str], values: list[str], exact: bool = False) -> DataFrame:
    """Cubes by group: the value set of each column, whose product may hold more than the records do.

    ``exact`` gives the records' own identifiers instead.
    """
    own = [c for c in values if not c.startswith("_")]
    if exact:
        return records.select(*split_by, *own).distinct()
    sets = [F.array_sort(F.collect_set(F.col(c))).alias(c) for c in own]
    return records.groupBy(*split_by).agg(*sets)


def hrefs(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with ``href``: links as absolute addresses, only those below the page's own address."""
    base = F.regexp_replace(F.col(url), r"[^/]*$", "")
    site = F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)
    link = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)href="([^"]*)"'), F.lit(1)))
    out = pages.select("*", base.alias("base"), site.alias("site"), link.alias("raw"))
    absolute = F.when(F.col("raw").rlike("^[a-z]+://"), F.col("raw")).when(F.col("raw").startswith("/"), F.concat("site", "raw")).otherwise(F.concat("base", "raw"))
    return out.withColumn("href", absolute).where(F.col("href").startswith(F.col("base")) & (F.col("href") != F.col("base"))).drop("base", "site", "raw")

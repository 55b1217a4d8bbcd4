"""Coordinate values as columns: typing, text, set algebra.  Everything stays in the JVM.

A coordinate is ``struct<k tinyint, i int, f double, s string, t timestamp_ntz>``
whose tag ``k`` says integer, float, string or datetime (0 to 3).  A coordinate
set is a sorted array of distinct coordinates, so that tags order before values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORD = "struct<k:tinyint,i:int,f:double,s:string,t:timestamp_ntz>"
_INT, _LEADING_ZERO = r"^[+-]?[0-9]+$", r"^[+-]?0[0-9]"
_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)$"


def coord(k: int, value: Column) -> Column:
    kinds = [("i", "int"), ("f", "double"), ("s", "string"), ("t", "timestamp_ntz")]
    parts = [(value if n == k else F.lit(None)).cast(t).alias(name) for n, (name, t) in enumerate(kinds)]
    return F.struct(F.lit(k).cast("tinyint").alias("k"), *parts)


def token(text: Column) -> Column:
    """The coordinate that one token stands for: integer, else float, else string; a leading zero keeps it a string."""
    whole = text.rlike(_INT) & text.try_cast("int").isNotNull() & ~text.rlike(_LEADING_ZERO)
    real = F.lower(text).rlike(_FLOAT) & ~text.rlike(_LEADING_ZERO)
    value = F.when(F.lower(text).rlike("^[+-]?inf$"), F.concat(F.regexp_extract(text, "^([+-]?)", 1), F.lit("Infinity"))).otherwise(text)
    return F.when(whole, coord(0, text.try_cast("int"))).when(real, coord(1, value.try_cast("double"))).otherwise(coord(2, text))


def from_text(text: Column) -> Column:
    """The coordinate set written as ``a/b/c``.

    Where all parts are integers and one has a leading zero, all stay strings;
    else every part is typed by itself.
    """
    parts = F.split(text, "/")
    keep = F.forall(parts, lambda p: p.rlike(_INT)) & F.exists(parts, lambda p: p.rlike(_LEADING_ZERO))
    typed = F.when(keep, F.transform(parts, lambda p: coord(2, p))).otherwise(F.transform(parts, token))
    return F.array_sort(F.array_distinct(typed))


def number_text(value: Column) -> Column:
    """A double without exponent and without a trailing ``.0``."""
    plain = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("decimal(38,18)").cast("string"))
    plain = F.when(plain.contains("."), F.rtrim(plain, F.lit("0"))).otherwise(plain)
    return F.when(F.isnan(value) | F.abs(value).isin(float("inf")) | plain.isNull(), value.cast("string")).otherwise(plain)


def token_text(c: Column) -> Column:
    dated = F.date_format(c["t"], "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(c["i"].cast("string"), number_text(c["f"]), c["s"], dated)


def to_text(coords: Column) -> Column:
    return F.array_join(F.transform(coords, token_text), "/")


def joined(values: Column) -> Column:
    """Any sorted array of values as ``a/b/c``."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), "/")


def intersection(a: Column, b: Column) -> Column:
    """``struct<intersection, only_a, only_b>`` of two sets, sorted."""
    return F.struct(
        F.array_sort(F.array_intersect(a, b)).alias("intersection"),
        F.array_sort(F.array_except(a, b)).alias("only_a"),
        F.array_sort(F.array_except(b, a)).alias("only_b"),
    )


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def contains(coords: Column, value: Column) -> Column:
    return F.array_contains(coords, value)


def index_of(coords: Column, value: Column) -> Column:
    """Place of a value in a sorted set, from 0; null if it isn't there."""
    return F.nullif(F.array_position(coords, value), F.lit(0)) - 1


def singles(coords: Column) -> Column:
    """One set of one for each value, to be exploded."""
    return F.transform(coords, lambda c: F.array(c))


def kind(coords: Column) -> Column:
    """Name of a set's type: empty, integers, floats, strings, datetimes or mixed."""
    tags = F.array_distinct(F.transform(coords, lambda c: c["k"].cast("int")))
    names = F.array(*map(F.lit, ["integers", "floats", "strings", "datetimes"]))
    return F.when(F.size(coords) == 0, "empty").when(F.size(tags) > 1, "mixed").otherwise(F.get(names, tags[0]))


def datetime(text: Column) -> Column:
    """A timestamp without zone from RFC 3339, ``Y-m-d H:M:S``, ``Y-m-d``, ``YYYYMMDD`` or ``YYYYMMDDTHHMM``; else null."""
    zoned = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    forms = [(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{8}T\d{4}$", "yyyyMMdd'T'HHmm")]
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.when(zoned, text).try_cast("timestamp").cast("timestamp_ntz"))
    plain = [F.try_to_timestamp(F.when(text.rlike(r), text), F.lit(f)).cast("timestamp_ntz") for r, f in forms]
    return F.coalesce(utc, *plain)

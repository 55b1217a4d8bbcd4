"""The typing rules of :mod:`cubeloom.functions.coords` for Python values, used by driver-side parsers of small documents."""

from __future__ import annotations

import datetime as dt
import math
import re

Value = int | float | str | dt.datetime
_INT = re.compile(r"[+-]?[0-9]+")
_ZERO = re.compile(r"[+-]?0[0-9]")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", re.IGNORECASE)
_LIMIT = 2**31


def token(text: str) -> Value:
    if not _ZERO.match(text):
        if _INT.fullmatch(text) and -_LIMIT <= int(text) < _LIMIT:
            return int(text)
        if _FLOAT.fullmatch(text):
            return float(text)
    return text


def from_text(text: str) -> list[Value]:
    parts = text.split("/")
    keep = all(map(_INT.fullmatch, parts)) and any(map(_ZERO.match, parts))
    return ordered(parts if keep else map(token, parts))


def adapter_tokens(text: str) -> list[Value]:
    """The rule of the listings: trimmed tokens, empty ones skipped."""
    return ordered(token(p.strip()) for p in text.split("/") if p.strip())


def checked(value: object) -> Value:
    """A JSON or Python scalar as a value; integers beyond 32 bits and non-finite numbers in JSON are errors."""
    if isinstance(value, bool) or value is None:
        raise TypeError(f"{value!r} is no coordinate")
    if isinstance(value, int) and not -_LIMIT <= value < _LIMIT:
        raise OverflowError(f"{value} does not fit 32 bits")
    if isinstance(value, int | float | str | dt.datetime):
        return value
    raise TypeError(f"{value!r} is no coordinate")


def rank(v: Value) -> int:
    return 0 if isinstance(v, int) else 1 if isinstance(v, float) else 2 if isinstance(v, str) else 3


def ordered(values) -> list[Value]:
    """Sorted distinct values: integers, floats, strings, datetimes."""
    seen = {(rank(v), "nan" if isinstance(v, float) and math.isnan(v) else v): v for v in values}
    return [seen[k] for k in sorted(seen, key=lambda k: (k[0], (k[1] == "nan", 0.0 if k[1] == "nan" else k[1]) if k[0] == 1 else k[1]))]


def text(v: Value) -> str:
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S")
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    if isinstance(v, float) and not math.isnan(v) and not math.isinf(v):
        return f"{v:.18f}".rstrip("0") if "e" in repr(v) else repr(v)
    return str(v)

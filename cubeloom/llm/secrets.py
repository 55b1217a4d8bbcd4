"""Secret scans with a trigram inverted index.

For every rule a Boolean query over trigrams is derived from its parsed regular
expression: sequences join their literal alternatives, alternations give OR,
optional parts give nothing.  Texts are indexed block by block: the trigrams of
the lower-cased UTF-8 that occur in some query get a posting list of the
documents of the block.  A rule's query intersects and unites posting lists,
and only the documents left run the regular expression.  A rule without
mandatory trigrams, like a run of hexadecimal digits, scans every text.

Spans are code points with an exclusive end.  The base kinds are the first
three of ``RULES``; further ones add spans and change none of the base.

Defined results: null texts count as empty; a text without spans has an empty
list and the digest of the empty string; texts are scanned whole; repeated rows
each get their row; other columns are kept, those named like a result replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cubeloom.llm.bpe import BLOCK_BYTES, map_column
from cubeloom.llm.common import utf8_bytes

#: Alternatives of a sequence that are multiplied out, and characters of a class that are.
MOST_STRINGS, MOST_CHARS = 64, 4

Query = tuple  # ("any",), ("tri", code), ("and", [queries]) or ("or", [queries])
ANY: Query = ("any",)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters; ASCII letters in either case where ``fold``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False
    regex: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0)))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
]
RULES = BASE + MORE


def trigrams(text: str) -> set[int]:
    data = text.lower().encode()
    return {data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)}


def _both(a: Query, b: Query) -> Query:
    return b if a == ANY else a if b == ANY else ("and", [a, b])


def _strings(options: set[str]) -> Query:
    """What texts with one of the strings must have."""
    own = [sorted(trigrams(s)) for s in sorted(options)]
    if not own or not all(own):
        return ANY
    return ("or", [("and", [("tri", t) for t in ts]) for ts in own])


def _walk(tokens) -> tuple[set[str] | None, Query]:
    """(all strings that match exactly, or None; what every match must have)."""
    run: set[str] | None = {""}
    exact, query = True, ANY
    for op, arg in tokens:
        own: set[str] | None
        name, more = str(op), ANY
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN":
            own = set() if all(str(o) in ("LITERAL", "RANGE") for o, _ in arg) else None
            for o, a in arg if own is not None else ():
                low, high = (a, a) if str(o) == "LITERAL" else a
                own |= {chr(c).lower() for c in range(low, min(high, low + 99) + 1)}
            own = own if own and len(own) <= MOST_CHARS else None
        elif name == "SUBPATTERN":
            own, more = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(b) for b in arg[1]]
            sets = [s for s, _ in parts]
            own = set().union(*sets) if all(s is not None for s in sets) else None
            if own is None:
                every = [_both(_strings(s) if s is not None else ANY, q) for s, q in parts]
                more = ANY if ANY in every else ("or", every)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            own, inner = _walk(body)
            if own is not None and (low, high) == (0, 1):
                own = own | {""}
            elif own is not None and low == high and low <= 3:
                own = {a for a in own} if low == 1 else {a * low for a in own} if len(own) == 1 else None
                more = inner if low else ANY
            else:
                more = _both(_strings(own) if own is not None else ANY, inner) if low else ANY
                own = None
        elif name == "AT":
            own = {""}
        else:
            own = None
        query = _both(query, more)
        joined = {a + b for a in run for b in own} if run is not None and own is not None and len(run) * len(own) <= MOST_STRINGS else None
        if joined is None:
            exact = False
            query = _both(query, _strings(run) if run else ANY)
            run = own if own is not None else {""}
        else:
            run = joined
    return (run, query) if exact else (None, _both(query, _strings(run)))


def query_of(pattern: str) -> Query:
    """The trigram query of a regular expression; ``ANY`` if nothing is mandatory."""
    exact, query = _walk(re._parser.parse(pattern))
    return _both(_strings(exact), query) if exact is not None else query


def codes_of(query: Query) -> set[int]:
    return {query[1]} if query[0] == "tri" else set().union(*map(codes_of, query[1])) if len(query) > 1 else set()


def evaluate(query: Query, postings: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """Ascending numbers of the documents that satisfy a query, of ``n``."""
    if query == ANY:
        return np.arange(n)
    if query[0] == "tri":
        return postings(query[1])
    parts = [evaluate(q, postings, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    out = min(parts, key=len)
    for p in parts:
        out = np.intersect1d(out, p, assume_unique=True)
    return out


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.queries = [query_of(r.pattern) for r in rules]
        codes = sorted(set().union(*map(codes_of, self.queries)))
        self.place = {c: k for k, c in enumerate(codes)}
        self.lookup = np.full(1 << 24, -1, np.int16)
        self.lookup[codes] = np.arange(len(codes))

    def candidates(self, texts: pa.Array) -> list[np.ndarray]:
        """For each rule the numbers of the texts that it must be run on."""
        data, bounds = utf8_bytes(texts, lower=True)
        data = data.astype(np.int32)
        found = self.lookup[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]] if len(data) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(found >= 0)
        doc = np.searchsorted(bounds, at, "right") - 1
        keys = np.unique(found[at].astype(np.int64) * len(texts) + doc)
        starts = np.searchsorted(keys, np.arange(len(self.place) + 1) * len(texts))
        postings = lambda c: keys[starts[k := self.place[c]] : starts[k + 1]] - k * len(texts)
        return [evaluate(q, postings, len(texts)) for q in self.queries]

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of each text, ascending."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        own, out = texts.to_pylist(), [[] for _ in texts]
        for k, (rule, docs) in enumerate(zip(self.rules, self.candidates(texts), strict=True)):
            for d in docs.tolist():
                out[d] += [(i, k, j) for i, j in rule.spans(own[d])]
        return [sorted(x) for x in out]


def scan(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, base: int = len(BASE), keep_text: bool = True) -> DataFrame:
    """``df`` with one count column ``n_<kind>`` for each base kind, base_sha256 and spans (``kind:start:end``, comma-joined)."""
    rules = RULES if rules is None else rules

    def make():
        scanner = Scanner(rules)
        write = lambda spans: ",".join(f"{rules[k].kind}:{i}:{j}" for i, k, j in spans)

        def f(texts: pa.Array) -> list[list]:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            found, at = [], 0
            while at < len(texts):
                n = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")) - at)
                found += scanner.spans(texts[at : at + n])
                at += n
            counts = [[sum(s[1] == k for s in x) for x in found] for k in range(base)]
            digests = [sha256(write([s for s in x if s[1] < base]).encode()).hexdigest() for x in found]
            return [*counts, digests, [write(x) for x in found]]

        return f

    strings = (T.StringType(), pa.string())
    fields = [(f"n_{r.kind}", T.LongType(), pa.int64()) for r in rules[:base]]
    return map_column(df, text, [*fields, ("base_sha256", *strings), ("spans", *strings)], make, keep_text)

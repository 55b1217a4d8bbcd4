"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is written as ``||host/path`` or ``text``, where ``*`` stands for any
characters, ``^`` for a separator (anything but letters, digits, ``_ - . %``,
or the end), a leading ``||`` anchors at the host or one of its parent domains,
and a last ``|`` at the end.  Rules are matched against the canonical ``host +
path`` of a URL.  :func:`read_rules` reads lists of such rules, of plain domains
and of hosts files.

For every rule the literal tokens ``[A-Za-z0-9]+`` that must stand as whole
tokens in any matching URL are derived from its text.  One aggregate counts
those tokens over the URLs, in lower case, and each rule is filed under its
rarest one.  The tokens of a URL fetch candidate rules from that index, and only
candidates run their regular expression.  Rules without a whole literal token are
candidates for every URL, and are applied row by row in either way.

Lists of up to ``INLINE_RULES`` rules travel inside the plan as a hash-bucketed
literal, so that nothing is shuffled.  Larger lists are joined by token, with the
same result; a token that is in more than ``HOT_ROWS`` URLs is dealt to several
groups, each with a copy of its rules.

Defined results: a null URL, or one without ``://``, has empty host and path
and fits no anchored rule; a URL of any length is judged whole; of rules that fit
the order of :class:`Rule` decides; an empty table gives an empty result;
repeated rows each get their row; other columns are kept by :func:`judge`, those
named like a result replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import fold_ascii, free_name

#: Rule lists up to this length are put into the plan; longer ones are joined.
INLINE_RULES = 500
BUCKETS = 256
#: Rows of one token that meet its rules in one group.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``priority`` decides between fitting rules, then the longer ``name``, then block before allow."""

    name: str
    pattern: str
    action: str
    priority: int = 0
    #: Whether letters fit in either case.
    fold: bool = False

    @property
    def _parts(self) -> tuple[bool, str, bool]:
        """Whether the pattern is anchored at the host, what is between, and whether it is anchored at the end."""
        body = self.pattern[2:] if self.pattern.startswith("||") else self.pattern
        ended = body.endswith("|")
        return self.pattern.startswith("||"), body[:-1] if ended else body, ended

    @property
    def regex(self) -> str:
        anchored, body, ended = self._parts
        head = ("(?i)" if self.fold else "") + (r"^(?:[^/]*\.)?" if anchored else "")
        special = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%\-]|\z)"}
        return head + "".join(special.get(c) or re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c) for c in body) + (r"\z" if ended else "")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens in lower case, with a literal non-token neighbour, or an anchor, on either side."""
        anchored, body, ended = self._parts
        out = []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left = body[m.start() - 1] if m.start() else ("|" if anchored else "*")
            right = body[m.end()] if m.end() < len(body) else ("|" if ended else "*")
            if left != "*" and right != "*":
                out.append(m.group().lower())
        return out


#: Options of list rules that mean the same for a page's address; any other asks for what an address doesn't tell.
_OPTIONS = {"important", "match-case", "document", "doc", "all"}
_DOMAIN = re.compile(r"(?:[A-Za-z0-9_-]+\.)+[A-Za-z0-9-]+\.?")


def parse_rule(line: str) -> Rule | None:
    """A rule of a filter list, a plain domain or a line of a hosts file; None for comments and for rules that hide
    elements, are regular expressions, or have options beyond ``_OPTIONS``."""
    text = line.strip()
    if not text or text[0] in "![" or re.search(r"#[@?$%]?#", text) or text.startswith("#"):
        return None
    if m := re.fullmatch(r"(?:0\.0\.0\.0|127\.0\.0\.1|::1?)\s+(\S+)(?:\s*#.*)?", text):
        text = m[1]
        if not _DOMAIN.fullmatch(text):
            return None
    if _DOMAIN.fullmatch(text):
        return Rule(text, f"||{text.rstrip('.').lower()}^", "block", fold=True)
    action, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    body, _, given = body.partition("$")
    options = {o.strip().lower() for o in given.split(",") if o.strip()}
    if not body or options - _OPTIONS or (body.startswith("/") and body.endswith("/") and len(body) > 1 and re.search(r"[\\\[({+?]", body)):
        return None
    if body.startswith("|") and not body.startswith("||"):  # from the start of the address: its scheme, then the host
        m = re.fullmatch(r"\|[a-z*]+://(.*)", body)
        if not m:
            return None
        body = f"||{m[1]}"
    # an exception beats a block, and an important rule any other
    return Rule(text, body, action, 2 * ("important" in options) + (action == "allow"), "match-case" not in options)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The distinct rules of text files, in the order of their text; they come to the driver, as rule lists are small."""
    lines = spark.read.text(path).distinct().orderBy("value").toLocalIterator()
    return [r for r in (parse_rule(x["value"]) for x in lines) if r is not None]


def domain_rule(action: str, text: str, priority: int = 1) -> Rule:
    """``host/path`` for a host with all its subdomains and the paths that start with the rule's."""
    return Rule(text, f"||{text}", action, priority)


DOMAIN_RULES = [
    domain_rule("block", "net/"),
    domain_rule("allow", "example.net/en/"),
    domain_rule("block", "example.com/de/"),
    domain_rule("allow", "org/fr/"),
]

#: The method's own patterns, for URLs that no domain rule decides.
PATTERN_RULES = [
    Rule("cheap-pills", "||cheap-pills.", "block"),
    Rule("spam-farm", "||spam-farm.", "block"),
    Rule("casino", "||casino.", "block"),
    Rule("/ads/", "/ads/", "block"),
    Rule("/banner/*/click", "/banner/*/click^", "block"),
    Rule("/tracking/pixel", "/tracking/pixel.", "block"),
    Rule("/docs/ads/", "/docs/ads/", "allow"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = fold_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.filter(F.array_distinct(F.split(fold_ascii(target), r"[^a-z0-9]+")), lambda t: t != "")


def filed(targets: DataFrame, column: str, rules: list[Rule]) -> tuple[list[tuple[str, Rule]], dict[str, int]]:
    """(token, rule) for each rule, under its rarest literal token or under "" if it has none; and the tokens' counts.

    What comes to the driver is one count per token that occurs in a rule.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        spark = targets.sparkSession
        known = spark.createDataFrame([(t,) for t in wanted], "token string")
        seen = targets.select(F.explode(_tokens(F.col(column))).alias("token"))
        seen = seen.where(F.col("token").isin(wanted)) if len(wanted) <= INLINE_RULES else seen.join(known, "token", "left_semi")
        counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), r) for r in rules], counts


def _rank(rule: Rule) -> int:
    return rule.priority * 10**9 + len(rule.name) * 2 + (rule.action == "block")


def _literal(rows: list[tuple[str, Rule]]) -> Column:
    kind = "array<struct<token:string,regex:string,rank:bigint,name:string,action:string>>"
    if not rows:
        return F.from_json(F.lit("[]"), kind)
    return F.array(
        *[
            F.struct(
                F.lit(t).alias("token"), F.lit(r.regex).alias("regex"), F.lit(_rank(r)).cast("long").alias("rank"),
                F.lit(r.name).alias("name"), F.lit(r.action).alias("action"),
            )
            for t, r in rows
        ]
    )


def _bucket(token: str) -> int:
    """The same for a Python string and for :func:`_bucket_of` of a column: by length and ends."""
    return (len(token) * 31 + ord(token[0]) * 7 + ord(token[-1])) % BUCKETS


def _bucket_of(token: Column) -> Column:
    return (F.length(token) * 31 + F.ascii(token) * 7 + F.ascii(F.right(token, F.lit(1)))) % BUCKETS


def _best_of(candidates: Column, url: Column) -> Column:
    fit = F.filter(candidates, lambda r: F.rlike(url, r["regex"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["action"].alias("action"))))


def _best_inline(rows: DataFrame, target: str, files: list[tuple[str, Rule]], out: str) -> DataFrame:
    buckets: dict[int, list[tuple[str, Rule]]] = {}
    for token, rule in files:
        if token:
            buckets.setdefault(_bucket(token), []).append((token, rule))
    index = F.create_map(*[x for b, own in sorted(buckets.items()) for x in (F.lit(b), _literal(own))]) if buckets else None
    general = _literal([x for x in files if not x[0]])
    url = F.col(target)
    candidates = general
    if index is not None:
        none = _literal([])
        fetched = F.transform(
            _tokens(url),
            lambda t: F.filter(F.coalesce(F.try_element_at(index, _bucket_of(t)), none), lambda r: r["token"] == t),
        )
        candidates = F.concat(general, F.flatten(fetched)) if any(not t for t, _ in files) else F.flatten(fetched)
    return rows.withColumn(out, _best_of(candidates, url))


def _best_joined(rows: DataFrame, target: str, files: list[tuple[str, Rule]], counts: dict[str, int], out: str) -> DataFrame:
    """Distinct targets fetch their candidates in a join by token; nothing is collected.

    Rules without a token are applied row by row; tokens of many targets are dealt to groups.
    """
    spark = rows.sparkSession
    groups = {t: -(-n // HOT_ROWS) for t, n in counts.items() if n > HOT_ROWS}
    index = spark.createDataFrame(
        [(t, k, r.regex, _rank(r), r.name, r.action) for t, r in files if t for k in range(groups.get(t, 1))],
        "token string, part int, regex string, rank long, name string, action string",
    )
    urls = rows.select(F.col(target).alias("u")).distinct()
    tokens = urls.select("u", F.explode(_tokens(F.col("u"))).alias("token"))
    part = F.lit(0)
    if groups:
        parts = F.create_map(*[F.lit(x) for item in sorted(groups.items()) for x in item])
        part = F.coalesce(F.pmod(F.xxhash64("u"), F.try_element_at(parts, F.col("token"))).cast("int"), part)
    fit = tokens.withColumn("part", part).join(index, ["token", "part"]).where(F.rlike(F.col("u"), F.col("regex")))
    best = fit.groupBy("u").agg(F.max(F.struct("rank", "name", "action")).alias("by token"))
    general = [x for x in files if not x[0]]
    joined = rows.join(best, rows[target].eqNullSafe(best["u"]), "left").drop("u")
    own = _best_of(_literal(general), F.col(target))
    return joined.withColumn(out, F.array_max(F.array_compact(F.array("by token", own))) if general else F.col("by token")).drop("by token")


def judge(
    df: DataFrame, url: str = "url", rules: list[Rule] | None = None, inline: int = INLINE_RULES
) -> DataFrame:
    """``df`` with host, path, rule (name of the deciding rule or null), its priority, and verdict (allow or block).

    Columns of ``df`` with one of these names are replaced.
    """
    rules = DOMAIN_RULES + PATTERN_RULES if rules is None else rules
    host, path = host_and_path(F.col(f"`{url}`"))
    target = free_name(df.columns, "target")
    best = free_name([*df.columns, target], "best")
    rows = df.withColumns({"host": host, "path": path}).withColumn(target, F.concat("host", "path"))
    files, counts = filed(rows, target, rules)
    rows = _best_inline(rows, target, files, best) if len(rules) <= inline else _best_joined(rows, target, files, counts, best)
    return rows.withColumns(
        {"rule": F.col(f"{best}.name"), "verdict": F.coalesce(F.col(f"{best}.action"), F.lit("allow")), "rule_priority": F.floor(F.col(f"{best}.rank") / 10**9)}
    ).drop(target, best)

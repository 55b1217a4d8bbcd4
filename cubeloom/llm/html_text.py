"""Main text of HTML pages by a site style tree, with markup as evidence beside it.

Every page is parsed once, to a written table of its blocks of text and of its
elements; what markup marks as a menu, header, footer, sidebar, notice, advert,
form or comment (by tag, role, class or id) is no part of it.

Site style tree: the DOMs of a site's distinct pages are merged by element path
(tags and classes from ``body`` down).  Pages with the same sequence of blocks
are one page: a story under many urls of a host is the content of one page.  For
each element of the tree, on ``m`` pages, there are

* presentation importance: the entropy, to the base ``m``, of the sequence of
  elements that stand below it on a page (repeats in a row are one), of which
  there are ``l`` kinds;
* content importance: the entropy, to the base ``m``, of the texts that it holds
  on a page;
* composite importance: ``(1 - GAMMA ** l) * presentation + GAMMA ** l * content``.

An element is noise if its composite importance is below a threshold and so is
that of all elements below it.  A single text has the importance
``1 - log n / log m`` where ``n`` of the ``m`` pages show it there, and is noise
below ``LEAST``.  Blocks of noise are removed; all others are the main text.

Markup sets the threshold.  It is ``BRANCH``; in an ``article`` or ``main``, and
for headings, one content must also be on more than half of the pages, as
authors repeat lines and headings; and text beside an ``article`` or ``main``
that holds most of a page's text must reach ``BESIDE``.

A site is a host, or where a host has fewer than ``LEAST_PAGES`` distinct pages
the hosts below its parent domain, or else all hosts.

Names judge an element only by whole tokens of class and id or by compounds of
known parts (``ad-slot``, ``site-footer``), never by other compounds, and never
headings and paragraphs by their id.  They never judge ``html``, ``body``,
``main`` and an ``article`` that is no comment, nor do names and forms judge
wrappers of most of a page (``PART``, ``WHOLE``).

The tree is gathered by aggregates with local pre-aggregation.  What a page
needs of it is its site's list of noise: ``LEAST`` bounds the number of single
texts by a small root of the site's pages.  The lists are written; Spark
broadcasts them only if their size in files is below its threshold, and joins by
site and salt otherwise, so that a host with a third of all pages goes to many tasks.

Defined results: null or empty html gives an empty text; a null url, or one
without a host, belongs to the host ``""``; repeated rows each get their row; a
text of any length is extracted whole, a page at a time; an empty table gives an
empty result; sites with fewer than ``LEAST_PAGES`` distinct pages have no noise
but by markup; other columns are kept, those named like a result replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm.common import stored
from cubeloom.llm.url_rules import host_and_path

#: Importance below which a single text is noise, and the least number of a site's distinct pages.
LEAST, LEAST_PAGES = 0.3, 5
#: Composite importance below which an element is noise; and that of text beside an article or main.
BRANCH, BESIDE = 0.4, 0.6
GAMMA = 0.9
#: A site's pages are dealt to this many groups before they meet its list of noise.
SALTS = 16

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never text of an article, and those that only are not outside of one.
_NEVER = {"head", "nav", "footer", "aside", "button", "select", "option", "datalist", "dialog", "menu", "svg", "math", "canvas", "object", "audio", "video", "map"}
_OUTSIDE = {"header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar"}
_NAMES = set("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies respond footer newsletter subscribe signup share sharing social related recommended pagination pager toolbar widget".split())
#: Other parts that a compound of names may have and still be one: places, shapes and numbers.
_FILLERS = set("area bar block body bottom box btn button center col column container content feed fixed form global group header icons inner items item left links link list main message mobile desktop outer page panel post primary reader region right row secondary section site slot sticky text top unit wrap wrapper zone".split())
_HEADS = {"header", "masthead", "topbar"}
#: Names that an element keeps however much of the page it holds.
_SURE = {"comment", "comments", "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose id is a name of their text, not of what they are.
_BY_CLASS_ONLY = _HEADINGS | {"p", "blockquote", "pre", "figure", "table"}
#: A form, or an element marked by a part of a name, is no boilerplate with more than half of a page's text; one marked by a whole name needs nine tenths.
PART, WHOLE = 0.5, 0.9
_CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "header", "footer", "aside", "nav", "form", "blockquote", "pre", "hr", "figure", "address", "fieldset", "details"}
_SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("bad", "marks", "name", "path", "region")

    def __init__(self, name: str, path: str, bad: bool, region: str, marks: tuple[int, ...] = ()):
        self.name, self.path, self.bad, self.region, self.marks = name, path, bad, region, marks

    def judged_as(self, other: Element) -> bool:
        return self.bad == other.bad and self.marks == other.marks


def _named(token: str, region: str) -> list[str]:
    """The names of boilerplate in a class or id: a whole token, or a compound that has known parts only."""
    names = _NAMES if region else _NAMES | _HEADS
    parts = [w for w in re.split(r"[-_]+", token) if w]
    own = [w for w in parts if w in names]
    return own if own and all(w in names or w in _FILLERS or re.fullmatch(r"[0-9x]+", w) for w in parts) else []


def _share(name: str, tokens: list[str], region: str) -> float | None:
    """The share of a page's text up to which an element is boilerplate by its names; None if it has no such name."""
    if name in ("html", "body", "main"):
        return None
    if name == "article":
        return 1.0 if any(not _SURE.isdisjoint(_named(t, region)) for t in tokens) else None
    shares = [PART] if name == "form" else []
    for token in tokens:
        if named := _named(token, region):
            shares.append(1.0 if not _SURE.isdisjoint(named) else WHOLE if token in named else PART)
    return max(shares, default=None)


def _judged(name: str, attributes: str, parent: Element, shares: list[float]) -> Element:
    """An element below ``parent``: whether it is boilerplate by tag or role, its marks by names (places in ``shares``),
    and whether it is in an article or main."""
    tokens: list[str] = []
    role = path = ""
    if "=" in attributes:
        for key, *values in _ATTR.findall(attributes):
            value = unescape("".join(values)).lower()
            if key.lower() == "role":
                role = value.strip()
            elif key.lower() == "class":
                tokens += value.split()
                path = "." + ".".join(value.split())
            elif name not in _BY_CLASS_ONLY:
                tokens += value.split()
    region = parent.region
    bad = parent.bad or name in _NEVER or role in _ROLES or (not region and name in _OUTSIDE)
    marks = parent.marks
    kind = "main" if role == "main" else "form" if role == "form" else name
    if not bad and (tokens or kind == "form") and (share := _share(kind, tokens, region)) is not None:
        shares.append(share)
        marks = (*marks, len(shares) - 1)
    if not bad and not region:
        region = "article" if name == "article" else "main" if kind == "main" else ""
    return Element(name, f"{parent.path}/{name}{path}", bad, region, marks)


def _settle(out: list[tuple[str, str, Element]], shares: list[float]) -> list[tuple[str, str, bool, str]]:
    """Blocks with their final judgement: marks that hold too much of a page's text are wrappers and void.  Where marks
    leave nothing of a page, the one with the most text and several blocks is void too."""
    if not shares:
        return [(path, text, e.bad, e.region) for path, text, e in out]
    open_ = [(len(text), e.marks) for _, text, e in out if not e.bad]
    total = sum(n for n, _ in open_)
    size, held = [0] * len(shares), [0] * len(shares)
    for n, marks in open_:
        for k in marks:
            size[k] += n
            held[k] += 1
    void = {k for k, share in enumerate(shares) if size[k] > share * total and (share == PART or held[k] > 1)}
    left = sorted((k for k in range(len(shares)) if k not in void and held[k] > 1), key=lambda k: (-size[k], k))
    while left and all(any(k not in void for k in marks) for _, marks in open_):
        void.add(left.pop(0))
    return [(path, text, e.bad or any(k not in void for k in e.marks), e.region) for path, text, e in out]


def blocks(html: str | None) -> list[tuple[str, str, bool, str]]:
    """(element path, text, boilerplate by markup, region) of each block of text, in page order."""
    html = html or ""
    stack = [Element("", "", False, "")]
    out: list[tuple[str, str, Element]] = []
    shares: list[float] = []
    parts: list[str] = []
    owner = stack[0]
    at = 0

    def flush():
        text = _SPACE.sub(" ", unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        if text:
            out.append((owner.path, text, owner))

    def holder() -> Element:
        return next((e for e in reversed(stack) if e.name not in _INLINE), stack[0])

    def pop_to(k: int):
        """Close elements; inline ones that were left open inside go with them."""
        nonlocal owner
        flush()
        del stack[k:]
        owner = holder()

    while True:
        m = _TAG.search(html, at)
        upto = m.start() if m else len(html)
        if upto > at:
            parts.append(html[at:upto])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if name in _INLINE:
                if found and all(e.name in _INLINE for e in stack[found:]):
                    if not stack[found].judged_as(stack[found - 1]):
                        pop_to(found)
                    else:
                        del stack[found:]
            elif found:
                pop_to(found)
            else:
                flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _VOID:
            if name not in _INLINE:
                flush()
            continue
        if name in _INLINE:
            own = _judged(name, m[3], stack[-1], shares)
            if not own.judged_as(stack[-1]):
                flush()
                stack.append(own)
                owner = own
            else:
                own.region = stack[-1].region
                stack.append(own)
            continue
        flush()
        if name in _CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name not in _INLINE), 0)
            if k and stack[k].name == "p":
                pop_to(k)
        elif name in _SELF_CLOSING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    pop_to(k)
                    break
                if stack[k].name in _SELF_CLOSING[name]:
                    break
        while len(stack) > 1 and stack[-1].name in _INLINE:  # a block ends what is open within the line
            stack.pop()
        owner = _judged(name, m[3], stack[-1], shares)
        if m[3].endswith("/") and name in ("svg", "path"):
            owner = holder()
        else:
            stack.append(owner)
    flush()
    return _settle(out, shares)


def content_key(path: str, text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{path}\0{text}".encode()) - 2**63


def _prefixes(path: str) -> list[str]:
    """Paths of an element and its ancestors."""
    return [path[:k] for k in range(1, len(path)) if path[k] == "/"] + [path]


def _element(path: str, inside: bool) -> int:
    """Key of an element of the tree.  Bit 1: it is, holds, or is in, an article, main or heading.  Bit 0 is free."""
    return content_key(path, "") & ~3 | 2 * inside


class Page:
    """A parsed page: its blocks that markup does not mark, and its elements."""

    def __init__(self, html: str | None):
        found = [b for b in blocks(html) if not b[2]]
        self.texts = [b[1] for b in found]
        paths = {b[0]: _prefixes(b[0]) for b in found}
        inside = {p for b in found if b[3] for p in paths[b[0]]}
        inside |= {p for p in paths if p.rpartition("/")[2].partition(".")[0] in _HEADINGS}
        keys = {p: _element(p, p in inside) for above in paths.values() for p in above}
        #: For each block: the key of its element, that of its text there, and whether it is beside an article or main.
        self.own = [keys[b[0]] for b in found]
        self.keys = [content_key(b[0], b[1]) & ~1 for b in found]
        regional = sum(len(b[1]) for b in found if b[3])
        most = 2 * regional > sum(map(len, self.texts))
        self.beside = [most and not b[3] for b in found]
        #: Digest of the sequence of blocks.
        self.digest = content_key("", "".join(f"{k} " for k in self.keys))
        styles: dict[str, list[int]] = {p: [] for p in keys}
        contents: dict[str, list[int]] = {p: [] for p in keys}
        #: Pairs of an element with a text of its own and another below it.
        self.pairs: set[tuple[int, int]] = set()
        for b, own, key in zip(found, self.own, self.keys, strict=True):
            for p in paths[b[0]]:
                if not styles[p] or styles[p][-1] != own:
                    styles[p].append(own)
                contents[p].append(key)
                if p in paths and p != b[0]:
                    self.pairs |= {(keys[p], keys[q]) for q in paths[b[0]] if len(q) > len(p)}
        write = lambda own: content_key("", " ".join(map(str, own)))
        self.elements = [(keys[p], write(styles[p]), write(contents[p])) for p in keys]

    def text(self, noise: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text; ``noise`` has keys of elements and texts, with bit 0 set for what is noise beside an article only."""
        return main_blocks(self.texts, self.own, self.keys, self.beside, noise)


def main_blocks(texts: list[str], own: list[int], keys: list[int], beside: list[bool], noise: frozenset[int] | set[int]) -> str:
    if not noise:
        return "\n\n".join(texts)
    return "\n\n".join(t for t, e, k, b in zip(texts, own, keys, beside, strict=True) if e not in noise and k not in noise and not (b and e | 1 in noise))


def extract(html: str | None, noise: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of one page, given the noise of its site."""
    return Page(html).text(noise)


_KEYS, _ARROW_KEYS = T.ArrayType(T.LongType()), pa.list_(pa.int64())
_PARSED = {
    "page": (T.LongType(), pa.int64()), "texts": (T.ArrayType(T.StringType()), pa.list_(pa.string())), "own": (_KEYS, _ARROW_KEYS), "keys": (_KEYS, _ARROW_KEYS),
    "beside": (T.ArrayType(T.BooleanType()), pa.list_(pa.bool_())), **{c: (_KEYS, _ARROW_KEYS) for c in ("elements", "styles", "contents", "tops", "below")},
}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 512):
            part = batch[k : k + 512]
            pages = [Page(h.as_py()) for h in part.column(2)]
            rows = [
                [p.digest, p.texts, p.own, p.keys, p.beside, *([e[i] for e in p.elements] for i in range(3)), *([x[i] for x in p.pairs] for i in range(2))]
                for p in pages
            ]
            made = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_PARSED.values())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["row", "host", *_PARSED])


def _parent(host: Column) -> Column:
    """The domain above a host of three labels or more; else the host."""
    return F.when(host.rlike(r"^[^.]+\.[^.]+\."), F.regexp_replace(host, r"^[^.]+\.", "")).otherwise(host)


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _salted(small: DataFrame, key: str) -> DataFrame:
    """``small`` once for each salt, so that rows of a hot key meet it in many tasks where it is not broadcast."""
    return small.where(F.col(key).isNotNull()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


#: The site of all hosts; no host is named so.
_ALL = "/"


def site_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of parsed pages: (host, site), (site, element, m, importance, most), and the distinct pages by site.

    ``most`` is the number of pages of the content that is on most of them.
    """
    columns = ["elements", "styles", "contents", "own", "keys", "tops", "below"]
    distinct = parsed.where(F.size("own") > 0).select("host", "page", *columns).dropDuplicates(["host", "page"])
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    hosts = hosts.withColumn("parent", _parent(F.col("host")))
    parents = hosts.groupBy("parent").agg(F.sum("n").alias("of_parent"))
    enough = lambda c: F.col(c) >= LEAST_PAGES
    site = F.when(enough("n"), F.col("host")).when(enough("of_parent"), F.concat(F.lit(_ALL), "parent")).otherwise(_ALL)
    sites = hosts.join(parents, "parent").select("host", site.alias("site"))  # hosts of a hot domain are rows of a few bytes
    sites, _ = stored(sites, "page-sites")
    host = F.col("host")
    levels = F.array_distinct(F.array(host, F.concat(F.lit(_ALL), _parent(host)), F.lit(_ALL)))
    used = _salted(sites.select("site").distinct(), "site")
    pages = distinct.withColumns({"site": F.explode(levels), "salt": _salt("page")}).join(used, ["site", "salt"], "left_semi")
    rows = pages.select("site", F.inline(F.arrays_zip("elements", "styles", "contents")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in ((0, "styles"), (1, "contents"))])
    counts = rows.select("site", F.col("elements").alias("element"), F.inline(kinds)).groupBy("site", "element", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k, c: F.when(F.col("kind") == k, c)
    n = F.col("n")
    nodes = counts.groupBy("site", "element").agg(
        F.sum(of(1, n)).alias("m"), F.max(of(1, n)).alias("most"), F.count(of(0, n)).alias("l"),
        F.sum(of(0, n * F.log(n))).alias("styles"), F.sum(of(1, n * F.log(n))).alias("contents"),
    ).where(F.col("m") >= LEAST_PAGES)
    entropy = lambda c: 1 - F.col(c) / (F.col("m") * F.log("m"))
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    importance = (1 - weight) * entropy("styles") + weight * entropy("contents")
    return sites, nodes.select("site", "element", "m", "most", importance.alias("importance")), pages


def noise(parsed: DataFrame) -> DataFrame:
    """(host, noise): packed keys of the noise of each host's site that has any; see :meth:`Page.text`."""
    sites, nodes, pages = site_tree(parsed)
    nodes, _ = stored(nodes, "site-tree")
    bound = F.when(F.col("element").bitwiseAND(2) == 0, True).otherwise(2 * F.col("most") > F.col("m"))
    nodes = nodes.withColumn("limit", F.when(bound & (F.col("importance") < BRANCH), 2).when(bound & (F.col("importance") < BESIDE), 1).otherwise(0))
    low = nodes.where("limit > 0")
    # an element with a text of its own is no more noise than the elements below it are
    pairs = pages.select("site", F.inline(F.arrays_zip("tops", "below"))).distinct()
    held = pairs.join(low.select("site", F.col("element").alias("below"), "limit"), ["site", "below"], "left")
    held = held.groupBy("site", F.col("tops").alias("element")).agg(F.min(F.coalesce("limit", F.lit(0))).alias("held"))
    low = low.join(held, ["site", "element"], "left").withColumn("limit", F.least("limit", F.coalesce("held", F.lit(2)))).where("limit > 0")
    low = low.select("site", F.col("element").bitwiseOR(F.when(F.col("limit") == 1, 1).otherwise(0)).alias("key"), F.col("limit") == 2)
    low = low.toDF("site", "key", "both").select("site", F.explode(F.when(F.col("both"), F.array("key", F.col("key").bitwiseOR(1))).otherwise(F.array("key"))).alias("key"))
    texts = pages.select("site", F.explode(F.array_distinct(F.arrays_zip("own", "keys"))).alias("x")).select("site", "x.own", "x.keys")
    texts = texts.groupBy("site", "own", "keys").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = texts.join(nodes.select("site", F.col("element").alias("own"), "m"), ["site", "own"]).where(1 - F.log("n") / F.log("m") < LEAST)
    texts = texts.where("own & 2 = 0 or 2 * n > m")
    every = low.unionByName(texts.select("site", F.col("keys").alias("key")))
    lists = every.groupBy("site").agg(F.array_sort(F.collect_set("key")).alias("noise"))
    return sites.join(lists, "site").select("host", "noise")


def main_text(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` without its html, and with text and n_chars (code points)."""
    names = [c for c in df.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("int")
    host, _ = host_and_path(F.col(f"`{url}`"))
    pages = df.select(row.alias("row"), host.alias("host"), F.col(f"`{html}`").alias("html"))
    schema = T.StructType([pages.schema["row"], pages.schema["host"]])
    for name, (kind, _) in _PARSED.items():
        schema = schema.add(name, kind)
    parsed, _ = stored(pages.mapInArrow(_parse, schema), "parsed-pages")
    low, _ = stored(noise(parsed), "site-noise")
    # copies of a page have one digest: rows are dealt by what else they hold too
    hashed = [F.col(f"row.`{c}`") for c, kind in df.dtypes if c in names and "map<" not in kind and "variant" not in kind]
    left = parsed.withColumn("salt", F.pmod(F.xxhash64("page", *hashed), F.lit(SALTS)).cast("int"))
    joined = left.join(_salted(low, "host"), ["host", "salt"], "left").select("row", "texts", "own", "keys", "beside", "noise")
    out_schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for own in zip(*(batch.column(k) for k in range(1, 6)), strict=True):
                packed = own[4].values.to_numpy().tobytes() if own[4].is_valid else b""
                if packed not in known:
                    if len(known) > 64:
                        known.clear()
                    known[packed] = frozenset(np.frombuffer(packed, np.int64).tolist())
                texts.append(main_blocks(*(x.as_py() for x in own[:4]), known[packed]))
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "n_chars"])

    out = joined.mapInArrow(run, out_schema)
    return out.select("row.*", "text", "n_chars") if names else out.drop("row")

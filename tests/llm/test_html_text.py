import math
import os
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from cubeloom.llm import html_text
from cubeloom.llm.html_text import blocks, extract, main_text

PAGE = (
    '<!DOCTYPE html><html><head><title>T&amp;</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>'
    '<!-- ad 0 --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>First\n  line.<br><p>Second &eacute;&#233; <i>it</i>al.</p><p></p>'
    '<form><p>Mail</p></form><aside>side</aside><section class="reader-comments"><p>nice</p></section><header><p>By me</p></header></article><footer>&copy; host</footer>'
)


def test_article():
    assert extract(PAGE) == "Title & more\n\nFirst line.\n\nSecond éé ital.\n\nBy me"
    assert extract(PAGE + "</body></html>") == extract(PAGE)
    assert extract(None) == extract("") == extract("<p> \n</p>") == ""
    assert extract("a < b &amp; c > d") == "a < b & c > d"
    assert extract("<p>one<p>two<div>three<!-- x") == "one\n\ntwo\n\nthree"
    assert extract("<main><p>in</p></main><p>out</p>") == "in\n\nout"  # no tree yet
    assert extract("<div role=navigation>m</div><div id='cookie-notice'>c</div><p>t<span class=ad>x</span>u</p>") == "t\n\nu"
    assert extract("<article><p>x" + " y" * 200_000 + "</p></article>") == "x" + " y" * 200_000
    assert extract('<p title="a>b">c</p><script>if (a<b) "</p>"') == "c"
    assert extract("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\n\nb\n\nc\n\nd"
    assert [b[0] for b in blocks('<body><div class="Big  box"><p>x</p></div>')] == ["/body/div.big.box/p"]


def test_site_style_tree(spark):
    page = lambda i: f"<body><div class=top>Same for all</div><div class=body><p>Text {i}.</p><p>Two share {i // 2}.</p></div></body>"
    rows = [(i, f"http://a.org/{i}", page(i), "t") for i in range(10)]
    rows += [(20, "http://b.org/", page(20), "t"), (21, None, None, None), (22, None, PAGE, "t"), (22, None, PAGE, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows) and all(r.n_chars == len(r.text) for r in out.collect())
    assert all(got[i] == f"Text {i}.\n\nTwo share {i // 2}." for i in range(10))
    assert got[20] == "Text 20.\n\nTwo share 10."  # a host of one page looks at the tree of all hosts
    assert got[21] == "" and got[22] == extract(PAGE)
    assert main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    page = lambda i, k: f"<body><div class=ad>Ad {i}</div><div class=top>Same for all</div><p>Text {k}.</p><p>More of {k}.</p></body>"
    rows = [(i, f"http://a.org/{i}", page(i, i if i % 3 else 0)) for i in range(60)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text {k}.\n\nMore of {k}." for i in range(60) for k in [i if i % 3 else 0])


def test_names_do_not_lose_whole_pages():
    text = "<p>" + "Real words. " * 20 + "</p><p>More of it.</p>"
    want = ("Real words. " * 20).strip() + "\n\nMore of it."
    assert extract(f'<body class="has-sidebar nav-open"><div class=ad>x</div>{text}</body>') == want
    assert extract(f'<html class="no-overlay"><body class="widget">{text}</body></html>') == want
    assert extract(f'<article class="post widget comments-open">{text}</article>') == want
    assert extract(f'<p>Home</p><div id="notice-of-appeal">{text}</div>') == "Home\n\n" + want
    assert extract(f'<form id=page><div class=sidebar>s</div><nav>n</nav>{text}</form>') == want
    assert extract(f'<div class="widget">{text}</div>') == want
    assert extract(f'<article><p>A teaser.</p></article><main>{text}</main>') == "A teaser.\n\n" + want
    assert extract(f'<main><article><p>A teaser.</p></article>{text}</main>') == "A teaser.\n\n" + want
    assert extract(f"<article><p>A teaser.</p></article><div>{text}</div>") == "A teaser.\n\n" + want
    # what is boilerplate by name stays out
    assert extract(f'<p>Short.</p><div class="reader-comments">{text}</div>') == "Short."
    assert extract(f'<p>Short one of ten words.</p><div class="cookie-notice">{text}</div>') == "Short one of ten words."
    assert extract(f'{text}<article class="comment"><p>c</p></article><form><p>Mail</p></form>') == want
    assert extract("<div class=ad>Buy</div>") == ""


def test_branches_and_articles(spark):
    def page(i):
        menu = f"<div class=slot><ul><li>Offer {i % 4}</li><li>Price {i % 4}</li></ul></div>"  # four variants: no single text is on most pages
        return f"<body>{menu}<article><p>Story {i} with its own words.</p><p>Read our terms.</p><p>Section {i % 4}</p><p>End of {i}.</p></article><div class=more><p>Note {i}</p></div></body>"

    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(200)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} with its own words.\n\nSection {i % 4}\n\nEnd of {i}.\n\nNote {i}" for i in range(200))
    rows = [(i, f"http://b.org/{i}", page(i).replace("article>", "div>")) for i in range(200)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} with its own words.\n\nEnd of {i}.\n\nNote {i}" for i in range(200))


def test_names_are_whole_tokens_and_text_beside_an_article_stays():
    assert extract("<main><h1>Title</h1><article><p>Body of the story, longer than its title.</p></article></main>") == "Title\n\nBody of the story, longer than its title."
    assert extract("<article><p>teaser</p></article><div><p>The long story</p></div>") == "teaser\n\nThe long story"
    assert extract('<article><div class="content ad-free"><p>whole body</p></div></article>') == "whole body"
    body = '<article><h2 id="social-history">Social</h2><p id="notice-period">Notice</p><p class="related-work">Related</p><h2 id="menu">Menu</h2><p>More</p></article>'
    assert extract(body) == "Social\n\nNotice\n\nRelated\n\nMenu\n\nMore"
    noise = "".join(f'<div class="{c}">x</div>' for c in ("ad-slot", "ad_banner_300x250", "site-footer", "nav-menu", "cookie-banner", "comment-list", "sidebar-left", "share-buttons share", "adsbygoogle", "top-menu"))
    assert extract(f"<p>Only this and nothing else, please.</p>{noise}<p class=ad>y</p>") == "Only this and nothing else, please."


def test_sites_without_markup(spark):
    """Menus, notices and footers in plain elements, on a large host, on a domain of small hosts, and beside an article."""

    def page(i, wrap):
        menu = "<div><span><div>Home</div></span><div>News</div><div>Sport</div></div>"
        slot = f"<section>Offer of the day {i % 3}</section>"
        story = f"<h2>Introduction</h2><p>Story {i} has words.</p><p>And {i} more of them.</p><h2>End {i}</h2>"
        return f"<body>{menu}{slot}<{wrap}>{story}</{wrap}><div>All rights reserved</div></body>"

    want = lambda i: f"Story {i} has words.\n\nAnd {i} more of them.\n\nEnd {i}"
    for wrap in ("div", "article"):
        rows = [(i, f"http://big.org/{i}", page(i, wrap)) for i in range(400)]
        rows += [(1_000 + i, f"http://h{i}.small.example.net/", page(1_000 + i, wrap)) for i in range(300)]
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        # one heading for all is no noise by itself: its element is not the same everywhere, its text is
        assert all(got[i] == want(i) for i, _, _ in rows)


class _Blocks(HTMLParser):
    """An independent reading of pages: (path, text, inside an article, noise by markup) of blocks, for the markup of the test tables."""

    SKIP, BLOCK = {"script", "style", "title"}, {"html", "head", "body", "nav", "ul", "li", "div", "article", "h1", "p", "footer", "meta"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.text, self.skip = [], [], "", False

    def end_block(self):
        text = " ".join(self.text.split())
        self.text = ""
        if text:
            names = [n for n, _ in self.stack]
            noise = bool({"nav", "footer"} & set(names)) or any("ad" in c for _, c in self.stack)
            self.out.append(("".join("/" + n + "".join("." + x for x in c) for n, c in self.stack), text, "article" in names, noise))

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.end_block()
            self.skip = True
        elif tag == "br":
            self.text += " "
        elif tag in self.BLOCK:
            self.end_block()
            if tag in ("p", "h1", "div", "footer", "article", "nav") and self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            if tag != "meta":
                self.stack.append((tag, (dict(attrs).get("class") or "").split()))

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip, self.text = False, ""
        elif tag in self.BLOCK and any(n == tag for n, _ in self.stack):
            self.end_block()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.text += data


def _read(html):
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.end_block()
    return [b[:3] for b in p.out if not b[3]]


def _brute(pages):
    """Texts by page id from (page_id, url, html), by dictionaries."""
    read = {k: (url.split("://")[1].split("/")[0].split("?")[0].lower(), _read(html)) for k, url, html in pages}
    above = lambda path: ["/".join(path.split("/")[: k + 1]) for k in range(1, len(path.split("/")))]
    heading = lambda path: path.rsplit("/", 1)[1].split(".")[0] in ("h1", "h2", "h3", "h4", "h5", "h6")
    distinct = {(host, tuple(b)) for host, b in read.values() if b}
    parent = lambda h: h.split(".", 1)[1] if h.count(".") > 1 else h
    n_host, n_parent = Counter(h for h, _ in distinct), Counter(parent(h) for h, _ in distinct)
    site = lambda h: h if n_host[h] >= 5 else "of " + parent(h) if n_parent[parent(h)] >= 5 else "all"
    noise = {}
    for s in {site(h) for h, _ in read.values()}:
        own = [b for h, b in distinct if s in (h, "of " + parent(h), "all")]
        styles, texts, single = defaultdict(Counter), defaultdict(Counter), Counter()
        for b in own:
            inside = {p for path, _, r in b if r for p in above(path)} | {path for path, _, _ in b if heading(path)}
            for e in {p for path, _, _ in b for p in above(path)}:
                below = [(path, t, path in inside) for path, t, _ in b if path == e or path.startswith(e + "/")]
                style = [(p, i) for k, (p, _, i) in enumerate(below) if not k or (below[k - 1][0], below[k - 1][2]) != (p, i)]
                styles[e, e in inside][tuple(style)] += 1
                texts[e, e in inside][tuple(below)] += 1
            single.update({((path, path in inside), t) for path, t, _ in b})
        found, m = Counter(), {e: sum(c.values()) for e, c in texts.items()}
        for e in texts:
            if m[e] >= 5:
                h = lambda c, m=m[e]: -sum(n / m * math.log(n / m, m) for n in c.values())
                w = 0.9 ** len(styles[e])
                importance = (1 - w) * h(styles[e]) + w * h(texts[e])
                if importance < 0.6 and (not e[1] or 2 * max(texts[e].values()) > m[e]):
                    found[e] = 2 if importance < 0.4 else 1
        least = Counter(found)
        for b in own:
            inside = {p for path, _, r in b if r for p in above(path)} | {path for path, _, _ in b if heading(path)}
            for top in {path for path, _, _ in b}:
                for q in {q for path, _, _ in b for q in above(path) if q.startswith(top + "/")}:
                    least[top, top in inside] = min(least[top, top in inside], found[q, q in inside])
        found = least
        for (e, t), n in single.items():
            if m[e] >= 5 and n > 1 and 1 - math.log(n, m[e]) < 0.3 and (not e[1] or 2 * n > m[e]):
                found[e, t] = 2
        noise[s] = found
    out = {}
    for k, (host, b) in read.items():
        inside = {p for path, _, r in b if r for p in above(path)} | {path for path, _, _ in b if heading(path)}
        most = 2 * sum(len(t) for _, t, r in b if r) > sum(len(t) for _, t, _ in b)
        worst = lambda path, t, host=host, inside=inside: max(noise[site(host)][path, path in inside], noise[site(host)][(path, path in inside), t])
        keep = [t for path, t, r in b if worst(path, t) < (1 if most and not r else 2)]
        out[k] = "\n\n".join(keep)
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert {r["page_id"]: r["text"] for r in main_text(df).collect()} == _brute(rows)


def test_trees_against_brute_force(spark):
    """Pages whose elements vary, so that presentation counts too."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(300):
        parts = [f"<div class=a>{rng.choice(['x', 'y', 'z'])}</div>", f"<p>own {i}</p>", "<div class=b>same<p>fix</p></div>", f"<div class=c>top<p>{rng.randrange(150)}</p></div>"]
        parts += [f"<article><h1>{rng.choice(['News', f'Head {i}'])}</h1><p>{rng.randrange(9)}</p></article>"] * rng.randrange(2)
        rng.shuffle(parts)
        rows.append((i, f"http://{rng.choice('abc')}{rng.randrange(4) * (i % 2)}.site.org/", f"<html><body>{''.join(parts[: rng.randint(1, 5)])}</body></html>"))
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == _brute(rows)
    assert sum(got[k] != html_text.extract(h) for k, _, h in rows) > 100

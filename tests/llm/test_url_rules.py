import re

import pytest

from cubeloom.llm import url_rules as ur

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y", "http://example.net", "http://example.net/EN/x", "https://myexample.net/en/",
    "http://x.example.com/de/", "http://example.com/den", "http://a.org/fr/", "http://a.org?/fr/", "http://net/", "ftp://a.net#/en/",
    "http://www.cheap-pills.example.com/x", "http://cheap-pillsx.com/", "http://a.com/ads/1", "http://a.com/docs/ads/1", "http://a.com/banner/7/click",
    "http://a.com/banner/7/clicks", "http://spam-farm.example.org/en/", "x://y://z/", "http://bücher.example.net/en/é", "http://casino./", "http://a.com/x/tracking/pixel.gif",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in rules if re.search(r.regex.replace(r"\z", r"\Z"), host + path)), key=lambda r: (r.priority, len(r.name), r.action == "block"), default=None)
    return url, host, path, best and best.name, best.action if best else "allow"


@pytest.mark.parametrize("inline", [500, 0])
def test_judge(spark, inline):
    rules = [*ur.DOMAIN_RULES, *ur.PATTERN_RULES, ur.Rule("*", "*zz*", "block")]
    df = spark.createDataFrame([(u, "b") for u in URLS], "url string, best string")
    got = ur.judge(df, rules=rules, inline=inline)
    assert got.columns == ["url", "best", "host", "path", "rule", "verdict", "rule_priority"]
    want = sorted((brute(u, rules) for u in URLS), key=str)
    assert sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == want
    assert ur.judge(df.limit(0), inline=inline).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("example.net/en/",), ("example.net/",), ("a.net/",)], "t string")
    assert [t for t, _ in ur.filed(df, "t", [ur.domain_rule("allow", "example.net/en/"), ur.Rule("x", "*zz*", "block")])[0]] == ["en", ""]


def test_lists_are_read(spark, tmp_path):
    lines = [
        "! comment", "[Adblock Plus 2.0]", "example.com##.ad", "||ads.example.com^", "@@||ads.example.com/ok/", "0.0.0.0 Tracker.Example.net # why", "127.0.0.1 localhost",
        "plain.example.org", "/banner/*/img^", "||cdn.example.com^$third-party", "||big.example.com^$important", "@@||big.example.com^", "/Case/$match-case", "|https://start.example.com/x",
        "/end.js|", r"/re[0-9]+x/", "||ads.example.com^", "# note", "",
    ]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    rules = ur.read_rules(spark, str(tmp_path / "list.txt"))
    assert len(rules) == 10
    urls = {
        "http://x.ADS.example.com/A": "block", "http://ads.example.com/ok/": "allow", "http://ads.example.com.evil.org/": "allow", "http://tracker.example.net/": "block",
        "http://a.plain.example.org/x": "block", "http://q.org/banner/7/IMG": "block", "http://q.org/banner/7/imgs": "allow", "http://cdn.example.com/": "allow",
        "http://big.example.com/": "block", "http://q.org/Case/": "block", "http://q.org/case/": "allow", "http://start.example.com/xy": "block", "http://q.org/end.js": "block",
        "http://q.org/end.jsx": "allow", "no url": "allow",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for inline in (500, 0):
        assert {r["url"]: r["verdict"] for r in ur.judge(df, rules=rules, inline=inline).collect()} == urls


def test_ten_thousand_rules_both_ways(spark, monkeypatch):
    import random

    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(60))
    forms = ["||{0}.{1}.com^", "||{0}.com/{1}", "/{0}/{1}/", "/{0}/*/{1}.", "-{0}-", "{0}*{1}", "||com/{0}/", "||{0}."]
    rules = [ur.Rule(f"r{k}", rng.choice(forms).format(word(), word()), rng.choice(["block", "allow"]), rng.randrange(3), rng.random() < 0.5) for k in range(10_000)]
    rules = [r for r in rules if r.tokens] + [r for r in rules if not r.tokens][:200]
    urls = [f"http://{word()}.{word().upper()}.com/{word()}/{rng.choice(['', word() + '/'])}{word()}.html" for _ in range(300)] + [None, "x", "http://com/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id int, url string")
    monkeypatch.setattr(ur, "HOT_ROWS", 50)  # the token com is in nearly all

    compiled = [(ur._rank(r), r.name, r.action, re.compile(r.regex.replace(r"\z", r"\Z"))) for r in rules]
    want = {}
    for k, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        fit = [(a, n, v) for a, n, v, x in compiled if x.search(host.lower() + path)]
        want[k] = max(fit)[1:] if fit else (None, "allow")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in ur.judge(df, rules=rules).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 100
    some = rules[:400]
    ways = [sorted((r["page_id"], r["rule"], r["verdict"]) for r in ur.judge(df, rules=some, inline=n).collect()) for n in (500, 0)]
    assert ways[0] == [tuple(x) for x in ways[1]]

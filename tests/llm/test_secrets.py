import random
import re
from hashlib import sha256

from cubeloom.llm import secrets

PATTERNS = {
    "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
TEXTS = [
    None, "", "token = abc", 'x TOKEN="abcdef" é password:hunter22 passwd=', "secret=token=abcdef", "API_KEY : 'zzzzzz' apikey=1234567",
    "AKIA" + "A" * 16 + " AKIA123 AKIAé" + "AKIA" + "0" * 40, "é" * 9 + "ab" * 12 + "g" + "0" * 23 + " " + "f" * 30, "ſecret=abcdef toKen=abcdef",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "db://user:pw@host", "token=0123456789abcdef0123456789abcdef", "x" * 200_000 + " secret = " + "y" * 50_000,
]


def brute(text):
    text, rows = text or "", []
    for k, (kind, pat) in enumerate(PATTERNS.items()):
        for m in re.finditer(pat, text):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                rows.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind))
    rows.sort()
    kinds = [r[3] for r in rows]
    return (*(kinds.count(k) for k in PATTERNS), sha256(",".join(r[2] for r in rows).encode()).hexdigest()), [r[2] for r in rows]


def test_scan(spark):
    rng = random.Random(1)
    bits = ["token", "Secret", "=", ":", " ", '"', "abcdef", "AKIA", "ABCDEFGH12345678", "é", "deadbeef" * 3, "\n", "api", "_", "key"]
    texts = TEXTS + ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    for r in secrets.scan(df).collect():
        want, spans = brute(r.text)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want, r.text
        mine = r.spans.split(",") if r.spans else []
        assert [s for s in mine if s.split(":")[0] in PATTERNS] == spans
    kinds = {s.split(":")[0] for r in secrets.scan(df).collect() for s in r.spans.split(",") if s}
    assert {"private_key", "code_host", "url_login"} <= kinds
    assert secrets.scan(df.limit(0)).count() == 0


def test_queries_are_mandatory():
    assert secrets.query_of(r"[0-9a-f]+") == secrets.ANY
    assert secrets.query_of(r"a*b?") == secrets.ANY
    assert secrets.query_of(r"AKIA[A-Z0-9]+") != secrets.ANY
    rng = random.Random(2)
    for pattern, samples in {
        r"(foo|barx)y?baz+": ["foobaz", "barxybazzz"], r"ab[cd]e(fg)*": ["abce", "abdefgfg"], r"x{3}yz": ["xxxyz"], r"(?:abc){2,}d": ["abcabcd"], r"^key$": ["key"],
    }.items():
        query = secrets.query_of(pattern)
        for s in samples:
            assert re.fullmatch(pattern, s)
            have = secrets.trigrams("".join(rng.choices("qw", k=3)) + s)
            assert len(secrets.evaluate(query, lambda c, have=have: [0] if c in have else [], 1))
    scanner = secrets.Scanner(secrets.RULES)
    import pyarrow as pa

    found = scanner.candidates(pa.array(["nothing here", "a token here"], pa.large_string()))
    assert found[0].tolist() == [1] and found[1].tolist() == [] and found[2].tolist() == [0, 1]


def test_blocks_find_the_same(monkeypatch):
    import pyarrow as pa

    texts = [None, "ÄÖÜ" * 50, *TEXTS * 3]
    scanner = secrets.Scanner(secrets.RULES)
    whole = scanner.spans(pa.array(texts, pa.string()))
    for i in range(0, len(texts), 3):
        assert scanner.spans(pa.array(texts, pa.string())[i : i + 3]) == whole[i : i + 3]

import base64
import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from cubeloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  a  b ", "a \n b", "\n a", "it's 'tis  ''s !'s", "<|endoftext|> x", "🙂 é🙂🙂  🙂", "\r\n \r\n", "a  ", ". a.b\nc .d\n.e .\n",
    "\tb\x1c c  d  e　 f", "Größe übermäßig — naïve, ½ ²x", "x" * 20_000, "lorem ipsum, dolor. " * 2_000,
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_encoder_matches_a_whole_text_encoding(reference):
    rng = random.Random(4)
    encoder, decoder = bpe.Encoder(PATH), bpe.Decoder(PATH)
    parts = ["the", "Word", " ", "  ", "\n", ".", ",", "é", "ß", "'s", "'", "7", "½", "🙂", "\u00a0", "\u2003", "日本", "_", "\t", "<|endoftext|>"]
    for text in TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(1500)]:
        ids = encoder.ids(text)
        assert ids.tolist() == reference(text or ""), text
        assert decoder.decode(ids) == (text or "").encode()
        assert "".join(decoder.pieces(ids)) == (text or "")


def test_random_unicode_against_the_library():
    rng = random.Random(9)
    library = bpe.load(PATH)
    pool = [chr(c) for c in [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x558, 0x661, 0x65E5, 0xFF11, 0x1F600, 0x10400]]
    texts = ["".join(rng.choices([*pool, "'s", "'ll", " 're", " ", "\n ", "a", "é"], k=rng.randint(0, 20))) for _ in range(20_000)]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = bpe.Encoder(PATH)
    got = [ids[i:j].tolist() for ids, b in encoder.encode_column(pa.array(texts)) for i, j in zip(b, b[1:], strict=False)]
    assert got == want
    ended = [ids[i:j].tolist() for ids, b in encoder.encode_column(pa.array(texts[:50]), 7) for i, j in zip(b, b[1:], strict=False)]
    assert ended == [[*w, 7] for w in want[:50]]


def test_memo_of_two_generations_and_other_splitters(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    encoder = bpe.Encoder(PATH)
    for text in ["one two three four five", "two six", "one two seven eight nine"] * 3:
        assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.memo) <= 8
    encoder.splitter = None  # as for a vocabulary that splits otherwise
    assert encoder.ids("one  two's ½").tolist() == encoder.tokenizer.encode("one  two's ½", add_special_tokens=False).ids


def test_round_trip_and_arrays(spark, reference):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string").repartition(3)
    got = {r.doc_id: r for r in bpe.round_trip(df, PATH).collect()}
    assert bpe.round_trip(df, PATH, keep_text=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for i, t in enumerate(TEXTS):
        ids = reference(t or "")
        want = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    both = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert all(r.ids == reference(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in both)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_offsets(spark, reference):
    df = spark.createDataFrame([("née 🙂 x",), (None,), ("",), ("a\n\n🙂🙂日本",)], "text string").coalesce(1)
    for r in bpe.encode_with_offsets(df, PATH).collect():
        text = r.text or ""
        assert r.ids == reference(text)
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends, strict=True))
        assert {k for a, b in zip(r.starts, r.ends, strict=True) for k in range(a, b)} == set(range(len(text)))

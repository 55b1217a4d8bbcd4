"""Byte-level BPE over Arrow batches: encoding, offsets and decoding.

The tokenizers library does the merges.  A text is split into pieces as the
vocabulary's pattern splits it (contractions, runs of letters, of numbers and of
other characters, each with a space before it, and white space), but over the
bytes of a whole block of texts at once: every byte gets the class of its
character, and pieces begin where classes change.  The classes of characters
beyond ASCII are asked of the library's own pre-tokenizer when they are first
met.  Arrow then finds the distinct pieces of the block, and only those go
through the merges, unless the worker remembers them from earlier blocks.

Vocabulary files are read on the workers from a path that is a parameter.  A
file with another pre-tokenizer or with a normalizer is encoded by the library
alone.

Defined results: a null text counts as empty and has no ids; a text of any
length is encoded whole, in memory of a small multiple of its size; repeated
rows each get their row; an empty table gives an empty result; other columns are
carried along untouched, those named like a result are replaced.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cubeloom.llm.common import utf8_bytes

#: Pieces that one worker remembers in each of two generations, and their greatest length in bytes.
MEMO_PIECES, MEMO_BYTES = 400_000, 64
#: Rows and bytes of text that are worked on at a time; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 8_192, 6_000_000

#: Classes of characters; the end of a text is a class of its own.
_END, _LETTER, _NUMBER, _OTHER, _SPACE = range(5)
_ASCII = np.full(256, _OTHER, np.uint8)
_ASCII[0x30:0x3A] = _NUMBER
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = _LETTER
_ASCII[0x09:0x0E] = _ASCII[0x20] = _SPACE
#: The endings that the pattern splits off after an apostrophe.
_ONE_LETTER, _TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_to_char() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load(path: str):
    """The tokenizer in a file; strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class Splitter:
    """Finds where the pieces of texts begin."""

    def __init__(self, pre_tokenizer):
        self.pieces = pre_tokenizer.pre_tokenize_str
        #: The class of every code point beyond ASCII that was met, else 0.
        self.known = np.zeros(0x110000, np.uint8)

    def _ask(self, char: str) -> int:
        """A character's class: with what it stays in one piece."""
        for kind, fellow in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
            if len(self.pieces(fellow + char)) == 1:
                return kind
        return _SPACE

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte of UTF-8 belongs to."""
        out = _ASCII[data]
        first = np.flatnonzero(data >= 0xC2)
        lead = data[first]
        for size, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
            at = first[(lead >= low) & (lead < high)]
            if not len(at):
                continue
            code = data[at].astype(np.int32) & (0xFF >> (size + 1))
            for k in range(1, size):
                code = code << 6 | data[at + k] & 0x3F
            kinds = self.known[code]
            if not kinds.all():
                for c in np.unique(code[kinds == 0]).tolist():
                    self.known[c] = self._ask(chr(c))
                kinds = self.known[code]
            for k in range(size):
                out[at + k] = kinds
        return out

    def begins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places at which pieces begin; the bytes at ``ends``, one after each text, are pieces themselves."""
        kinds = self.classes(data)
        kinds[ends] = _END
        begin = np.ones(len(data), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
        begin[ends] = True
        # of white space before other characters the last one stands alone, and a plain space goes with what follows
        after = np.flatnonzero(begin[1:] & (kinds[:-1] == _SPACE) & (kinds[1:] != _END)) + 1
        last = after - 1
        for _ in range(2):  # to the first byte of that white space
            last = last - ((data[last] & 0xC0) == 0x80)
        begin[last] = True
        begin[after[data[after - 1] == 0x20]] = False
        # an apostrophe that begins a piece takes an ending of one or two letters with it
        quote = np.flatnonzero(data == 0x27)
        quote = quote[begin[quote]]
        quote = quote[kinds[quote + 1] == _LETTER]
        one, two = data[quote + 1], data[quote + 2]
        size = np.isin(one, np.frombuffer(_ONE_LETTER, np.uint8)).astype(np.int64)
        for a, b in _TWO_LETTERS:
            size[(one == a) & (two == b)] = 2
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        begin[quote + 1 + size] = True
        return np.flatnonzero(begin)


class Encoder:
    """Encodes texts to packed little-endian ids."""

    def __init__(self, path: str, dtype: str = "<u4"):
        self.dtype = dtype
        self.kind = np.dtype(dtype).char
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        usual = all(pre.get(k) == v for k, v in _SPLIT.items()) and not spec.get("normalizer")
        self.splitter = Splitter(self.tokenizer.pre_tokenizer) if usual else None
        self.chars = "".join(c for _, c in sorted(byte_to_char().items()))
        #: From a piece to its packed ids: the present generation, and the one before it.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        memo, older, kind, chars = self.memo, self.older, self.kind, self.chars
        merge = self.tokenizer.model.tokenize
        out: list = list(map(memo.get, pieces))
        for k in [k for k, x in enumerate(out) if x is None]:
            piece = pieces[k]
            ids = older.get(piece)
            if ids is None:
                ids = array(kind, [t.id for t in merge(piece.decode("latin-1").translate(chars))]).tobytes()
            if len(piece) <= MEMO_BYTES:
                memo[piece] = ids
            out[k] = ids
        return out

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) block by block: text ``i`` of a block has ``ids[bounds[i]:bounds[i + 1]]``, with ``end_id`` after it if given."""
        at = 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            n = min(BLOCK_ROWS, max(1, int(np.searchsorted(sizes, done + BLOCK_BYTES, "right")) - at))
            yield (self._block if self.splitter else self._whole)(texts[at : at + n], [] if end_id is None else [end_id])
            at += n

    def _block(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = utf8_bytes(texts)
        begins = self.splitter.begins(data, bounds[1:] - 1)
        ended = np.searchsorted(begins, bounds[1:] - 1)
        offsets = np.append(begins, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        which[ended] = len(coded.dictionary)
        packed = self._merged(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        packed.append(array(self.kind, end).tobytes())
        lens = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(self.dtype).itemsize
        ids, upto = ragged(np.frombuffer(b"".join(packed), self.dtype), (np.cumsum(lens) - lens)[which], lens[which])
        return ids, upto[np.concatenate([[0], ended + 1])]

    def _whole(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        own = [[*e.ids, *end] for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([k for ids in own for k in ids], self.dtype), np.cumsum([0, *map(len, own)])

    def packed(self, text: str | None) -> bytes:
        return next(self.encode_column(pa.array([text], pa.string())))[0].tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(path: str, dtype: str = "<u4") -> Encoder:
    """The encoder of this process: a Python worker keeps what it has learnt from task to task."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


class Decoder:
    """Decodes ids to bytes by the reversed byte table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        char_to_byte = {c: b for b, c in byte_to_char().items()}
        pieces = spec["model"]["vocab"]
        self.table: list[bytes] = [b""] * (max([*pieces.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for piece, k in pieces.items():
            self.table[k] = bytes(map(char_to_byte.__getitem__, piece)) if all(c in char_to_byte for c in piece) else piece.encode()
        for t in spec["added_tokens"]:
            self.table[t["id"]] = t["content"].encode()
        self.data = np.frombuffer(b"".join(self.table), np.uint8)
        self.lens = np.array([len(x) for x in self.table], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds): token ``i`` of ``ids`` stands for ``bytes[bounds[i]:bounds[i + 1]]``."""
        return ragged(self.data, self.starts[ids], self.lens[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids)[0].tobytes()

    def pieces(self, ids: np.ndarray) -> list[str]:
        """Text by token; bytes of a character that several tokens share come with the last of them."""
        import codecs

        utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        out = [utf8.decode(self.table[k]) for k in ids.tolist()]
        if out:
            out[-1] += utf8.decode(b"", True)
        return out


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[starts[i] : starts[i] + lens[i]]`` one after the other, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(lens)])
    at = np.repeat(starts - bounds[:-1], lens)
    at += np.arange(len(at))
    return values[at], bounds


Fields = list[tuple[str, T.DataType, pa.DataType]]


def map_column(
    df: DataFrame, column: str, fields: Fields, make: Callable[[], Callable[[pa.Array], list[list]]], keep_column: bool = True
) -> DataFrame:
    """``df`` and further columns that are computed from one of its columns, a batch at a time.

    ``make`` runs once in each task.  Columns of ``df`` with a name in
    ``fields`` are replaced; the column itself stays where ``keep_column``.
    """
    new = {n.lower() for n, _, _ in fields}
    at = df.columns.index(column)
    keep_at = [k for k, c in enumerate(df.columns) if c.lower() not in new and (keep_column or k != at)]
    schema = T.StructType([*(df.schema[k] for k in keep_at), *(T.StructField(n, t) for n, t, _ in fields)])
    names = [f.name for f in schema]
    kinds = [a for _, _, a in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            made = [pa.array(x, kind) for x, kind in zip(f(batch.column(at)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep_at] + made, names)

    return df.mapInArrow(run, schema)


LONGS = (T.ArrayType(T.LongType()), pa.list_(pa.int64()))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` and the ids of each text, as an array."""

    def make():
        encoder = encoder_of(path)
        return lambda texts: [[ids[i:j] for ids, b in encoder.encode_column(texts) for i, j in zip(b, b[1:], strict=False)]]

    return map_column(df, text, [(out, *LONGS)], make)


def offsets(texts: pa.Array, ids: np.ndarray, bounds: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """The character range [starts, ends) of its own text that each of ``ids`` stands for."""
    data, ends = utf8_bytes(texts)
    n_ids = np.diff(bounds)
    before = np.cumsum(decoder.lens[ids])  # bytes up to the end of each token; the texts' own without the ends between them
    last = before + np.repeat(np.arange(len(n_ids)), n_ids)
    first = last - decoder.lens[ids]
    char = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte, counted over all texts
    base = np.repeat(char[ends[:-1]] - 1, n_ids)
    return char[first] - 1 - base, char[last - 1] - base


def encode_with_offsets(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` and ids with the character range [starts, ends) that each token stands for.

    Tokens that share the bytes of one character all have that character's range.
    """

    def make():
        encoder, decoder = encoder_of(path), Decoder(path)

        def f(texts: pa.Array) -> list[list]:
            out: list[list] = [[], [], []]
            at = 0
            for ids, b in encoder.encode_column(texts):
                own = [ids, *offsets(texts[at : at + len(b) - 1], ids, b, decoder)]
                for column, values in zip(out, own, strict=True):
                    column += [values[i:j] for i, j in zip(b, b[1:], strict=False)]
                at += len(b) - 1
            return out

        return f

    return map_column(df, text, [("ids", *LONGS), ("starts", *LONGS), ("ends", *LONGS)], make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and the bytes that each list of ids stands for; a null list gives no bytes."""

    def make():
        decoder = Decoder(path)
        return lambda lists: [[decoder.decode(np.array(x or [], np.int64)) for x in lists.to_pylist()]]

    return map_column(df, ids, [(out, T.BinaryType(), pa.binary())], make)


def round_trip(df: DataFrame, path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` and n_tokens, ids_sha256 (of ids as little-endian 32-bit integers) and decoded_sha256."""

    def make():
        encoder, decoder = encoder_of(path), Decoder(path)

        def f(texts):
            count, coded, decoded = [], [], []
            for ids, b in encoder.encode_column(texts):
                data, upto = decoder.decode_all(ids)
                for i, j in zip(b.tolist(), b[1:].tolist(), strict=False):
                    count.append(j - i)
                    coded.append(sha256(ids[i:j]).hexdigest())
                    decoded.append(sha256(data[upto[i] : upto[j]]).hexdigest())
            return [count, coded, decoded]

        return f

    fields = [
        ("n_tokens", T.LongType(), pa.int64()),
        ("ids_sha256", T.StringType(), pa.string()),
        ("decoded_sha256", T.StringType(), pa.string()),
    ]
    return map_column(df, text, fields, make, keep_text)

"""Byte-level BPE encoding and decoding over a sentencepiece model that is serialised directly from a rank file.

Each byte is written as one printable character; every entry of the vocabulary becomes a normal piece in these
characters, scored by its negative rank, so that the best-scored merge is the one of lowest rank. The normaliser is the
identity. Texts are split by the pre-token pattern; a pre-token that is an entry itself gets its rank, any other is
encoded by the model. Decoding maps ids to their bytes.

The ids of a text are kept as little-endian unsigned 32-bit integers in one binary column, which Arrow moves as it is.
The vocabulary file is read by the driver and broadcast; its size is checked.

Defined results: a null text counts as empty and has no ids; null ids decode to no bytes; repeated rows are encoded one by
one; an empty table gives an empty result; other columns pass through, except one that has the name of the result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import give_back

#: Largest vocabulary file that is broadcast.
MAX_VOCABULARY_BYTES = 64_000_000
#: Pre-tokens a worker remembers, each of at most CACHED_CHARS characters.
CACHE, CACHED_CHARS = 100_000, 64
#: Characters beyond which a text's pre-tokens are taken in blocks of BLOCK.
LONG_TEXT, BLOCK = 1_000_000, 100_000
#: Rows that a worker answers at a time.
ROWS = 256


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable and not a blank, else one from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, rest = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(rest)
            rest += 1
    return [out[b] for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Entry -> rank, from lines of base 64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece k is the entry of rank k; ranks without an entry are unused pieces, and the
    unknown piece comes last."""
    chars, entries = byte_characters(), {r: e for e, r in ranks.items()}
    normal, unknown, unused = 1, 2, 5
    out = bytearray()
    size = max(entries, default=-1) + 1
    for k in range(size):
        piece = "".join(chars[b] for b in entries[k]) if k in entries else f"{k}"
        out += _bytes(1, _bytes(1, piece.encode()) + b"\x15" + struct.pack("<f", -k) + _int(3, normal if k in entries else unused))
    out += _bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _int(3, unknown))
    bpe = 2
    out += _bytes(2, _int(3, bpe) + _int(4, size + 1) + _int(40, size) + _int(41, -1) + _int(42, -1) + _int(43, -1))
    out += _bytes(3, _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0))
    return bytes(out)


class Codec(dict):
    """Pre-token -> packed ids, filled as needed, and the inverse table; each side is built when it is first used."""

    def __init__(self, data: bytes, pattern: str):
        super().__init__()
        self.data, self.source = data, pattern

    @cached_property
    def pattern(self):
        import regex

        return regex.compile(self.source)

    @cached_property
    def characters(self) -> dict[int, str]:
        return dict(enumerate(byte_characters()))

    @cached_property
    def whole(self) -> dict[str, int]:
        chars = byte_characters()
        return {"".join(chars[b] for b in e): r for e, r in read_ranks(self.data).items()}

    @cached_property
    def model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=serialise(read_ranks(self.data)))

    @cached_property
    def table(self) -> dict[int, bytes]:
        return {r: e for e, r in read_ranks(self.data).items()}

    def __missing__(self, token: str) -> bytes:
        mapped = token.encode().decode("latin-1").translate(self.characters)
        rank = self.whole.get(mapped)
        ids = [rank] if rank is not None else self.model.encode(mapped)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        found, out = (m[0] for m in self.pattern.finditer(text)), bytearray()
        while part := list(islice(found, BLOCK)):
            out += b"".join(map(self.__getitem__, part))
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a file of the driver's machine
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def _mapped(df: DataFrame, column: str, outs: tuple[str, ...], path: str, pattern: str, make: Callable[[Codec, str | bytes | None], tuple[bytes, ...]]) -> DataFrame:
    """df with the binary columns ``outs`` that make(codec, value of ``column``) returns."""
    df = df.drop(*[c for c in outs if c != column])
    kept = [c for c in df.columns if c not in outs]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(c, T.BinaryType(), True) for c in outs]])
    data, at = _vocabulary(df, path), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                made = list(zip(*(make(codec, x.as_py()) for x in part.column(at)), strict=True))
                columns = [part.column(i) for i, c in enumerate(part.schema.names) if c not in outs]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m, pa.binary()) for m in made)], names=[*kept, *outs])
                del made
        codec.clear()
        give_back()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with ``out``: the ids of ``text``, packed."""
    return _mapped(df, text, (out,), path, pattern, lambda codec, x: (codec.encode(x or ""),))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with ``out``: the bytes of the packed ``ids``."""
    return _mapped(df, ids, (out,), path, "", lambda codec, x: (codec.decode(x or b""),))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", back: str = "decoded") -> DataFrame:
    """encode() and then decode() in one pass: a task needs one worker process and one vocabulary."""

    def both(codec: Codec, x: str | None) -> tuple[bytes, bytes]:
        ids = codec.encode(x or "")
        return ids, codec.decode(ids)

    return _mapped(df, text, (out, back), path, pattern, both)

"""BPE against tiktoken, and decoding back."""

import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from shotlake.llm import bpe


@pytest.fixture(scope="module")
def codec():
    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    return bpe.Codec(data, P.PATTERN), enc


def test_as_tiktoken(codec, monkeypatch):
    own, enc = codec
    rng = random.Random(1)
    alphabet = "abcdefgh éÜß漢字\n\t\r  '\x1c\x85  sdreTHE019#$%  😀<|endoftext|>"
    texts = ["", "a" * 5000, "ab" * 2000, "the" * 900, "漢" * 700, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000))]
    for t in texts:
        ids = own.encode(t)
        assert ids == struct.pack(f"<{len(ids) // 4}I", *enc.encode_ordinary(t))
        assert own.decode(ids) == t.encode()
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    for t in texts[:200]:
        assert own.decode(own.encode(t)) == t.encode()


def test_all_code_points(codec):
    own, enc = codec
    for at in range(0, 0x110000, 37):
        if not 0xD800 <= at < 0xE000:
            t = f"a{chr(at)}{chr(at)} {chr(at)}1 {chr(at)}!  {chr(at)} b"
            ids = own.encode(t)
            assert ids == struct.pack(f"<{len(ids) // 4}I", *enc.encode_ordinary(t)), hex(at)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "Hello wörld", None), (3, "Hello wörld", "z"), (3, "Hello wörld", "z")], "doc_id long, text string, ids string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == [(0, "Hello wörld"), (1, ""), (2, ""), (3, "Hello wörld"), (3, "Hello wörld")]
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0

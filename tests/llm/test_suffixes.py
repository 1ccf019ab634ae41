"""Repeated strings against a plain set of strings."""

import hashlib
import random

from shotlake.llm import queries, suffixes


def brute(rows):
    """doc rows (id, text) -> (id, bytes, removed, spans, digest)."""
    least = {}
    key = lambda i: (i is not None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if w not in least or key(i) < least[w]:
                least[w] = key(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def digests(cut):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in cut.collect()), key=str)


def test_made_texts(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) - 10)
            parts.insert(rng.randrange(len(parts)), s[a : a + rng.randrange(40, 120)])
        rows.append((i, "".join(parts)))
    rows += [(200, None), (201, ""), (None, shared[0]), (202, "a" * 3000), (203, "a" * 60), (204, "x" + "ab" * 400), (5, rows[5][1]), (5, shared[1]), (205, rows[7][1]), (206, "a" * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(suffixes.remove_repeats(df)) == brute(rows)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    few = [(1, "short"), (2, None), (3, "short")]
    assert digests(suffixes.remove_repeats(spark.createDataFrame(few, "doc_id long, text string"))) == brute(few)


def test_one_anchor_under_many_spans(spark):
    """A rule of dashes between ever new neighbours is a hot anchor; its strings are dealt by their bytes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(160):
        line = "-" * rng.choice([30, 40, 60, 90])
        rows.append((i, "".join(f"{word()} {word()} {line} {rng.choice('xyz')}" for _ in range(6))))
    rows += [(300, rows[7][1] + rows[3][1]), (None, rows[9][1][:200]), (4, "-" * 500), (301, "-" * 51), (302, ("-" * 49 + "x") * 5)]
    want = brute(rows)
    for hot in (2, 10**9):
        assert digests(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot)) == want


def test_digit_passes_let_bytes_decide():
    """Strings of one group that differ in any byte are told apart; groups of one id are never removed."""
    import numpy as np

    base = b"abcdefghij" * 5
    texts = [base, base[:49] + b"!", base, b"!" + base[1:], base[:25] + b"\0" + base[26:], base, b"\0" * 50, b"\0" * 50]
    x = np.frombuffer(b"".join(texts), np.uint8)
    ids = np.array([5, 1, 3, 1, 0, 3, 9, 8])
    got = suffixes.equal_strings(x, np.arange(8) * 50, np.zeros(8, np.uint64), ids)
    assert got.tolist() == [True, False, False, False, False, False, True, False]
    assert suffixes.equal_strings(x, np.arange(8) * 50, np.arange(8).astype(np.uint64), ids).tolist() == [False] * 8


def test_long_texts_in_pieces(monkeypatch):
    """A text that is hashed in several pieces has the same anchors' strings covered once."""
    import numpy as np
    import pyarrow as pa

    from shotlake.llm.textvec import flat, pieces

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (10, 2000, 49, 50, 700, 0, 51)]
    x, bounds = flat(pa.array(texts))
    for size in (10**6, 300, 64):
        seen = {}
        for a, b, own in pieces(bounds, size, suffixes.WINDOW - 1):
            for t, s, n in zip(*(c.tolist() for c in suffixes.anchors(x[a:b], own, a)[:3])):
                for k in range(s, s + n):
                    assert (t, k) not in seen
                    seen[t, k] = True
        assert len(seen) == sum(max(0, len(t) - 49) for t in texts)
    assert isinstance(x, np.ndarray)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op3_suffix_radix_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)

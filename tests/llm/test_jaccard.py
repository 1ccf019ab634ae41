"""Classes and links against all pairs in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from shotlake.llm import jaccard, queries, textvec
from shotlake.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], least.get(top(i)), links[i]) for i in range(n)), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_made(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    rows = []
    for i in range(12):
        base = [word() for _ in range(rng.randrange(30, 120))]
        for k in range(9):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            rows.append((i * 20 + k, rng.choice([" ", "\n"]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "two one"), (None, rows[0][1]), (906, rows[0][1]), (906, rows[0][1]), (907, "x " * 50), (908, "x " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df)) == brute(rows)
    assert got(jaccard.join(df, block=5)) == brute(rows)
    assert jaccard.join(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op4_lsh_forest_join(spark, sf_dir)) == brute(rows)


def test_depth():
    assert jaccard.depth(0.8, 24, 8, 0.9999) == 5
    assert jaccard.depth(0.8, 24, 8, 0.0) == 8
    assert jaccard.depth(0.1, 2, 8, 0.9999) == 1


def test_word_hashes_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n") for _ in range(n)) for n in (0, 5, 300, 1, 40, 0)] + ["x" * 100, "x" * 100, " "]
    x, bounds = textvec.flat(pa.array(texts))
    whole = textvec.word_hashes(x, bounds)
    assert np.diff(whole[1]).tolist() == [len(WORD.findall(t.encode())) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(textvec, "WORD_PIECE", size)
        part = textvec.word_hashes(x, bounds)
        assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    want = {v: top(v) for v in root if top(v) != v}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect())) == want


def test_recall_near_the_threshold():
    """Pairs of sets at similarity 0.8 share a prefix at the trees' floors with about the target recall."""
    floor = np.array(jaccard.floors(0.8, jaccard.TREES, jaccard.DEPTH, jaccard.RECALL))
    assert floor.min() == 5 and floor.max() == 6 and jaccard.floors(0.8, 24, 8, 0.5) == [8] * 24
    rng, sets = np.random.default_rng(5), []
    for _ in range(2000):
        u = rng.integers(0, 1 << 64, 250, dtype=np.uint64)
        sets += [u[:225], np.concatenate((u[:200], u[225:]))]  # 200 of 250 elements are common
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    labels = jaccard.minima(np.concatenate(sets), first, jaccard.TREES, jaccard.DEPTH).reshape(len(sets), jaccard.TREES, jaccard.DEPTH)
    shared = np.cumprod(labels[::2] == labels[1::2], axis=2).sum(axis=2)
    assert (shared >= floor).any(axis=1).sum() >= 1996


def test_strata_lose_no_pair(spark):
    """Sets at exactly 0.8 whose sizes differ most, in small blocks."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for i in range(25):
        w = [word() for _ in range(44 + i)]
        n = len(w) - 4  # shingles; the longer text has a quarter more
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w + [word() for _ in range(n // 4)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df, block=1)) == brute(rows)

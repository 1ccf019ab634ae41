"""The pipeline against plain Python, stage by stage."""

import hashlib
import re
import struct
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from shotlake.llm import bpe, secrets  # noqa: E402
from shotlake.llm.spans import joined  # noqa: E402


def judged(text):
    """Whether the rules reject a text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(g)
    covered = {p for i, x in enumerate(g) if seen[x] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    mean = len("".join(w)) / max(1, len(w))
    return (
        len(w) < 10
        or 100 * len(covered) > 20 * len(w)
        or len(re.findall(r"[#*$%&|<>]", text or "")) > len(w)
        or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        or not 1.5 <= mean <= 25
    )


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    # rules
    rows = {i: t for i, t in rows.items() if not judged(t)}
    # near copies
    sets = {}
    for i, t in rows.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and (both := len(sets[a] & sets[b])) and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[max(top(a), top(b))] = min(top(a), top(b))
    rows = {i: t for i, t in rows.items() if top(i) == i}
    # benchmark
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    wins = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        wins |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(x) for x in wins}

    def contaminated(t):
        w = words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins for p in range(k, k + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    rows = {i: t for i, t in rows.items() if not contaminated(t)}
    # secrets: the spans are tested elsewhere; here that they are cut out of the text
    kept = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    for r in secrets.scan(kept).select("row.doc_id", joined(secrets.F.col("found")).alias("f")).collect():
        out, at, text = [], 0, rows[r.doc_id]
        for x in filter(None, r.f.split(",")):
            kind, a, b = x.split(":")
            if int(a) >= at:
                out += [text[at : int(a)], f"<{kind.upper()}>"]
            at = max(at, int(b))
        rows[r.doc_id] = "".join(out) + text[at:]
    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    want = []
    for i, t in sorted(rows.items()):
        ids_ = enc.encode_ordinary(t)
        want.append((i, len(ids_), hashlib.sha256(struct.pack(f"<{len(ids_)}I", *ids_)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want
    assert 0 < len(got) < docs.count()


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (None, "word " * 5 + "some other words that say something new here", "en", None, 9), (3, "", None, None, None), (4, "password = hunter2hunter2 and many more words in this text that are all fine", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string"
    spark.createDataFrame([(*r, "clash") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 4}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0

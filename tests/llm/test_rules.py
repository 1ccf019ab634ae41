"""The cascade and the window join on odd rows; both against DuckDB on the tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shotlake.llm import decontaminate, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    found = c.execute(queries.ORACLES[name])
    order = [x[0] for x in found.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(repr(tuple(r[order.index(n)] for n in names)) for r in found.fetchall())


def test_cascade_order_does_not_matter(spark):
    texts = [None, "", "few words", "a b c d e " * 30, "one### two*** three$$$ four&&& five||| six### seven*** eight$$$ nine&&& ten%%% eleven",
             "same line here\n" * 12 + "and another one", "plain words that say something about nothing much at all in one line", "x" * 400 + " " + " ".join("y" * 90 for _ in range(12))]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    verdicts = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        out = quality.apply_rules(df, rules).collect()
        assert all(r.words == "mine" for r in out) and len(out) == len(texts)
        verdicts.append({r.doc_id: r.rejected_by is None for r in out})
    assert verdicts[0] == verdicts[1] == {i: i == 6 for i in range(len(texts))}
    assert quality.apply_rules(df.limit(0)).count() == 0
    costs = {"a": (1.0, 0.5), "b": (0.1, 0.2), "c": (1.0, 0.0)}
    assert [r.name for r in quality.order(costs, [quality.Rule(n, None) for n in "abc"])] == ["b", "a", "c"]


def test_windows(spark):
    """Both joins against plain Python, with short, empty and repeated items and texts."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    long = "the Quick brown-fox jumps over; the lazy dog and THEN it sleeps under a tree for É hours"
    items = [(1, long), (2, "quick brown"), (3, ""), (4, None), (5, "!!"), (None, "lazy dog"), (6, long), (6, long), (10, "é hours"), (11, "É hours")]
    docs = [(1, f"x {long.upper()} y"), (2, "Quick  BROWN fox"), (3, None), (4, ""), (5, "?"), (6, long), (6, long), (None, "quick brown"), (7, "quick"), (8, "quick brown " * 50), (9, " ".join(long.split()[2:]))]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, pos int")
    want = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, s in items:
            g = words(s)
            for x in range(max(1, len(g) - 12)) if g and k is not None else ():
                win = g[x : x + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(k)
        want.append((i, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = decontaminate.verdicts(decontaminate.hits(d, b, broadcast_bytes=limit)).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert decontaminate.hits(d.limit(0), b).count() == 0
    clean = decontaminate.verdicts(decontaminate.hits(d, b.limit(0))).agg(F.sum("n_hit"), F.count(F.lit(1))).first()
    assert tuple(clean) == (0, len(docs))

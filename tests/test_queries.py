"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from shotlake.plans import further, more, oracles, queries

QUERIES, ORACLES = queries.QUERIES | more.QUERIES | further.QUERIES, oracles.ORACLES | more.ORACLES | further.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    found = duck.execute(ORACLES[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == names
    want = sorted((tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"g8_kmeans"}


def test_kmeans_partitions_the_frames(spark, sf_dir):
    rows = QUERIES["g8_kmeans"](spark, sf_dir).collect()
    assert sum(r["size"] for r in rows) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert len({r["medoid"] for r in rows}) == len(rows) <= 8


def test_kmeans_is_a_fixed_point_of_lloyd(spark, sf_dir):
    """Every frame is nearest to the mean of its own cluster, but for ties of the last step."""
    import numpy as np

    from shotlake.operators import cluster
    from shotlake.sources.tables import frames

    rows = cluster.k_means(frames(spark, sf_dir), 8).collect()
    e, label = np.array([r["embedding"] for r in rows]), np.array([r["cluster"] for r in rows])
    centres = np.array([e[label == k].mean(axis=0) for k in sorted(set(label))])
    d = ((e[:, None] - centres[None]) ** 2).sum(axis=2)
    own = d[np.arange(len(e)), np.searchsorted(sorted(set(label)), label)]
    assert (own <= d.min(axis=1) + 0.05).mean() >= 0.97

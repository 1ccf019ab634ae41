"""Stored tables, hooks, ordered encoding and streams beyond what SQL can show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.functions import media, vectors
from shotlake.operators import clips, jobs, plugins, search, selection, shots, store, streams
from shotlake.session import shared_folder
from shotlake.sources.tables import micros
from shotlake.streaming import hooks, state


def fresh(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def test_table_refuses_unknown_columns(spark):
    path = fresh(spark, "jobs")
    store.create(spark, path, store.JOBS)
    with pytest.raises(ValueError, match="colour"):
        store.append(spark.createDataFrame([(1, "red")], "job_id long, colour string"), path, store.JOBS)
    assert store.read(spark, path, store.JOBS).count() == 0


def test_lookup_reaches_the_scan(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = store.lookup(d.select("doc_id", "lang"), "doc_id", 3)
    assert "EqualTo(doc_id,3)" in row._jdf.queryExecution().executedPlan().toString()
    assert row.count() == 1 and store.lookup(d, "doc_id", -1).count() == 0


def test_blobs_by_prefix(spark, tmp_path):
    for name in ("a/x.bin", "a/b/y.bin", "c/z.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    root = f"file://{tmp_path}"
    assert sorted(r.path for r in store.blobs(spark, root).collect()) == ["a/b/y.bin", "a/x.bin", "c/z.bin"]
    assert sorted(tuple(r) for r in store.blobs(spark, root, "a").collect()) == [("a/b/y.bin", 5), ("a/x.bin", 5)]


def test_numbers_go_on_without_gaps(spark):
    df = spark.createDataFrame([(x,) for x in range(0, 3000, 7)], "k long").repartition(5)
    got = sorted(map(tuple, store.numbered(df, "k", "id", 100).collect()))
    assert got == [(x, 100 + i) for i, x in enumerate(range(0, 3000, 7))]


def test_put_and_get(spark):
    base = spark.createDataFrame([("a", "1", None), ("b", "2", 50)], "key string, value string, expires_us long")
    now = F.lit(100).cast("long")
    new = store.put(base, spark.createDataFrame([("b", "3"), ("b", "4"), ("c", "5")], "key string, value string"), now, 1)
    assert sorted(map(tuple, store.get(new, now).collect())) == [("a", "1"), ("b", "4"), ("c", "5")]
    assert sorted(map(tuple, store.get(new, now + 1_000_000).collect())) == [("a", "1")]


def test_upsert_with_repeated_patches(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, x string, updated_at long")
    patch = spark.createDataFrame([(1, "n", 1), (1, "m", 2), (3, "new", 1), (None, "z", 1)], "k long, x string, seq long")
    got = jobs.upsert(table, patch, "k", ["x"], insert=True, order="seq", stamp=F.lit(9).cast("long"))
    assert sorted(map(tuple, got.collect())) == [(1, "m", 9), (2, "b", 0), (3, "new", 9)]


def test_refusal_raises_the_reason(spark):
    df = spark.createDataFrame([("a.mp4", 10), ("b.txt", 10)], "name string, size long")
    good = df.where("name = 'a.mp4'").select(media.accepted(F.col("name"), F.col("size")).alias("n"))
    assert good.collect()[0].n == 10
    with pytest.raises(Exception, match="refused: format"):
        df.select(media.accepted(F.col("name"), F.col("size"))).collect()


def test_first_error_of_an_encoder_is_raised(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(7)], "k long, i long, x double")
    got = streams.encode(rows, "k", "i", "x", 3, lambda v: v + 1).orderBy("i").collect()
    assert [(r.i, r.x, r.batch) for r in got] == [(i, i + 1.0, i // 3) for i in range(7)]

    def broken(v):
        raise ValueError("no weights")

    with pytest.raises(Exception, match="no weights"):
        streams.encode(rows, "k", "i", "x", 3, broken).collect()


def test_models_load_once_a_process(spark):
    made = []
    assert plugins.loaded("one", lambda: made.append(1) or 5) == plugins.loaded("one", lambda: made.append(1) or 6) == 5
    plugins.unload("one")
    assert plugins.loaded("one", lambda: 7) == 7 and made == [1]
    frames = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(5)], "job_id long, n long, embedding array<double>")
    got = plugins.embed_frames(frames, lambda m, w: m * w, "n", model=("weights", lambda: 3.0)).orderBy("frame_index").collect()
    assert [(r.frame_index, r.timestamp_ms, r.embedding) for r in got] == [(i, i * 500, [3.0 * i, 3.0]) for i in range(5)]


def test_hooks(spark, tmp_path):
    events = spark.createDataFrame([(1, 0, "pending"), (1, 1, "complete"), (2, 0, "failed")], "job_id long, seq long, status string")
    out = str(tmp_path / "told")

    def tell(kind, row):
        with open(f"{out}-{row['job_id']}-{row['seq']}", "w") as f:
            f.write(kind)
        raise RuntimeError("swallowed")

    hooks.callbacks(tell)(events, 0)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"told-1-0": "progress", "told-1-1": "complete", "told-2-0": "error"}
    tries, slept = [], []

    def send(payload):
        tries.append(payload)
        if len(tries) < 3:
            raise OSError("down")

    assert hooks.post(send, {"event": "complete"}, sleep=slept.append) and len(tries) == 3 and slept == [1.0, 2.0]
    assert not hooks.post(lambda p: 1 / 0, {}, sleep=slept.append)


def test_late_stamps_count_what_stood_before_them(spark):
    rows = spark.createDataFrame([(1, t) for t in (100, 200, 900)], "identifier long, us long")
    late = spark.createDataFrame([(1, 300)], "identifier long, us long")
    path = fresh(spark, "late")
    rows.coalesce(1).write.parquet(path)
    late.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("identifier long, us long").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.us: r.n for r in state.drained(state.stream_limit(stream, 3, 700), f"late_{np.random.randint(1 << 30)}").collect()}
    assert got[100] == 1 and got[200] == 2
    # late, 300 counts 100 and 200 but not 900; had its file come first, 900 would count it
    assert (got[300], got[900]) in {(3, 1), (1, 2)}


def test_drained_streams_lie_in_the_shared_folder(spark):
    path = fresh(spark, "requests")
    spark.range(40).select((F.col("id") % 4).alias("identifier"), (F.col("id") + 1).alias("us")).write.parquet(path)
    drain = lambda p: state.drained(state.stream_limit(spark.readStream.schema("identifier long, us long").parquet(p), 3, 100), f"drained_{np.random.randint(1 << 30)}")
    got = drain(path)
    assert got.inputFiles() and all(shared_folder(spark).removeprefix("file://") in f for f in got.inputFiles())
    assert sorted((r.identifier, r.us, r.n) for r in got.collect()) == [(k, k + 4 * i + 1, i + 1) for k in range(4) for i in range(10)]
    none = fresh(spark, "none")
    spark.range(0).select(F.col("id").alias("identifier"), F.col("id").alias("us")).write.parquet(none)
    assert drain(none).count() == 0


def test_long_jobs_keep_all_clips(spark):
    n = 4101
    rows = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), (3 * F.col("id")).alias("frame_index"), (F.col("id") * 1500).alias("timestamp_ms"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    got = clips.clips(rows).orderBy("clip_index").collect()
    assert [(r.clip_index, r.start, r.length) for r in got] == [(i, s, min(16, n - s)) for i, s in enumerate(range(0, n, 8)) if n - s >= 8]
    assert clips.clips(rows, mode="batch").count() == len(range(0, n, 8))
    assert [r.clip_index for r in clips.clips(rows, max_clips=500).orderBy("clip_index").collect()] == list(range(500))
    vectors_ = clips.clip_vectors(rows)
    assert vectors_.count() == len(got) and vectors_.agg(F.max("end_ms")).first()[0] == (n - 1) * 1500


def test_channel_bins_are_counted_without_arrays(spark, sf_dir):
    from shotlake.plans.further import v5_three_channels

    plan = v5_three_channels(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    values = spark.range(300_000).select(F.lit(1).alias("job_id"), (F.col("id") % 3).alias("channel"), (F.col("id") % 256).cast("int").alias("v"))
    got = {r.bin: r.share for r in shots.channel_shares(values).collect()}
    want = np.bincount([i % 3 * 64 + i % 256 // 4 for i in range(300_000)], minlength=192) / 300_000
    assert sorted(got) == list(range(192)) and np.allclose([got[k] for k in range(192)], want, atol=1e-9)


def test_micros_do_not_depend_on_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00.123456' AS ts")
    want = 1711852200123456
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert df.select(micros(F.col("ts")).alias("u")).collect()[0].u == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 8))
    f = spark.createDataFrame([(i % 2, i, m[i].tolist()) for i in range(90)], "job_id long, frame_index long, embedding array<double>")
    q = f.where("frame_index % 5 = 0").select(F.col("frame_index").alias("query_id"), F.col("embedding").alias("q"))
    unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + vectors.EPS)
    s = unit @ unit.T
    want = {(k, int(j)) for k in range(0, 90, 5) for j in np.lexsort((np.arange(90), -s[k]))[:4]}
    monkeypatch.setattr(search, "MAX_QUERIES", 7)
    got = search.multi_top_k(f, q, 4).collect()
    assert {(r.query_id, r.frame_index) for r in got} == want and len(got) == len(want)
    assert search.multi_top_k(f, q.limit(0), 4).count() == 0
    pairs = {(r.job_id, r.a, r.b): r.score for r in search.pairs(f, block=10).collect()}
    assert len(pairs) == 2 * 45 * 44 // 2
    assert all(a < b and abs(x - s[a, b]) < 1e-9 for (_, a, b), x in pairs.items())


def test_diverse_picks_as_the_matrix_would():
    rng = np.random.default_rng(4)
    e = rng.normal(size=(60, 5))
    unit = e / (np.linalg.norm(e, axis=1, keepdims=True) + 1e-7)
    d = np.round(1 - unit @ unit.T, 12)
    picks = [int(np.argmax(np.round(d.mean(axis=1), 12)))]
    while len(picks) < 9:
        least = d[picks].min(axis=0)
        least[picks] = -np.inf
        picks.append(int(np.argmax(least)))
    assert selection.pick_diverse(e, 9) == picks

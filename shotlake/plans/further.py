"""Registered queries over stored tables, caches, ordered encoding and streams that may fail; with their SQL, whose values
are written out here and not taken from the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotlake.functions import media as M
from shotlake.functions import vectors as V
from shotlake.operators import clips as C
from shotlake.operators import jobs, search, selection, shots, store, streams
from shotlake.plans import oracles as O
from shotlake.plans.queries import answers, event_frames, one, r6, requested, vector_shots
from shotlake.session import shared_folder
from shotlake.sources.tables import frames, histograms, micros, ordinals, requests, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


KEPT = O.ORACLES["g6_select"].replace("SELECT job_id, frame_index, timestamp_ms FROM kept", "")


# scans


@query(
    f"""WITH {O.E}, o AS (SELECT identifier AS job_id, event_id AS frame_index, row_number() OVER (PARTITION BY identifier ORDER BY event_id) - 1 AS n FROM e),
k AS (SELECT *, CASE WHEN job_id % 5 = 0 THEN 30.0 ELSE 7.0 END AS fps FROM o), t AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n) AS r FROM k WHERE n % greatest(1, CAST(floor(fps / 2.0) AS BIGINT)) = 0)
SELECT job_id, n, frame_index, CAST(fps AS DOUBLE) AS fps FROM t WHERE r <= 1000"""
)
def s4_selector_scan(spark, sf_dir):
    """The selector's scan: the settings' cap of 1000 frames, and the rate that was used."""
    fps = F.when(F.col("job_id") % 5 == 0, 0.0).otherwise(F.lit(7.0))
    s = C.stride_sample(event_frames(spark, sf_dir), fps, 2.0, 1000)
    return s.select("job_id", "n", "frame_index", F.when(fps > 0, fps).otherwise(30.0).alias("fps"))


@query(
    f"""WITH {O.E}, o AS (SELECT identifier AS job_id, event_id AS frame_index, row_number() OVER (PARTITION BY identifier ORDER BY event_id) - 1 AS n FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n) AS r FROM o WHERE n % CASE WHEN job_id % 5 = 0 THEN 1 ELSE 3 END = 0)
SELECT job_id, r - 1 AS pos, frame_index FROM t WHERE r <= 1000"""
)
def s5_detector_scan(spark, sf_dir):
    """The detector's scan has no fallback: a rate of 0 gives interval 1. Positions and the frames' own ids."""
    fps = F.when(F.col("job_id") % 5 == 0, 0.0).otherwise(F.lit(7.0))
    s = C.stride_sample(event_frames(spark, sf_dir), fps, 2.0, 1000, fallback=False)
    w = Window.partitionBy("job_id").orderBy("n")
    return s.select("job_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "frame_index")


HS = O.HD.replace("FROM h WINDOW", "FROM hs WINDOW").replace(", d AS (", ", hn AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_index) - 1 AS n FROM h), hs AS (SELECT * FROM hn WHERE n % 2 = 0), d AS (")


@query(f"WITH RECURSIVE {O.shots(HS, 0.1, 2)} SELECT job_id, pos, frame_index, round(distance, 6) AS distance FROM b")
def g3_shots_of_scan(spark, sf_dir):
    """Shots of a strided scan (4 frames a second, 2 wanted), with the positions in the scan and the frames' own ids."""
    scanned = C.stride_sample(ordinals(histograms(spark, sf_dir)), F.lit(4.0), 2.0, 1000, fallback=False)
    return shots.boundaries(scanned, 0.1, 2).select("job_id", "pos", "frame_index", r6("distance").alias("distance"))


# stored tables


@query(f"WITH RECURSIVE {O.FOLD} SELECT job_id, status, retries FROM fin WHERE job_id = 5")
def s11_get_job(spark, sf_dir):
    return store.lookup(jobs.fold_states(requested(spark, sf_dir)), "job_id", 5).select("job_id", "status", "retries")


@query("SELECT 'job:' || doc_id AS key, lang, source, n_chars, NULL::VARCHAR AS error FROM documents")
def s14_read_hash(spark, sf_dir):
    """Hashes of fields read back as rows; a field that a hash lacks is null."""
    d = table(spark, sf_dir, "documents")
    fields = d.select(F.concat(F.lit("job:"), "doc_id").alias("key"), F.explode(F.create_map(*[x for c in ("lang", "source", "n_chars") for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))
    h = store.hashes(fields)
    return h.select("key", *[F.col("hash")[c].alias(c) for c in ("lang", "source")], F.col("hash")["n_chars"].cast("long").alias("n_chars"), F.col("hash")["error"].alias("error"))


@query("SELECT c_custkey AS job_id, CASE WHEN c_nationkey = 3 THEN 'uploading' ELSE 'pending' END AS status, 'uploads/' || c_name || '.mp4' AS video_path, CAST(0.0 AS DOUBLE) AS progress, 0::BIGINT AS retry_count, NULL::VARCHAR AS error FROM customer")
def k1_insert_jobs(spark, sf_dir):
    """Job rows appended to a table with its defaults for what they lack; two appends, by two writers."""
    path, c = fresh(spark, "jobs"), table(spark, sf_dir, "customer")
    store.create(spark, path, store.JOBS)
    rows = c.select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_nationkey") == 3, "uploading").alias("status"), F.concat(F.lit("uploads/"), "c_name", F.lit(".mp4")).alias("video_path"))
    store.append(rows.where("c_nationkey < 10"), path, store.JOBS)
    store.append(rows.where("c_nationkey >= 10 OR c_nationkey IS NULL"), path, store.JOBS)
    return store.read(spark, path, store.JOBS).select("job_id", "status", "video_path", "progress", F.col("retry_count").cast("long").alias("retry_count"), "error")


@query("SELECT 'jobs' AS name, 9::BIGINT AS columns, 0::BIGINT AS rows UNION ALL SELECT 'clips', 7, 1 UNION ALL SELECT 'history', 7, 0")
def k7_create_tables(spark, sf_dir):
    """Tables made where there are none; making one again keeps its rows."""
    out = None
    for name, schema in (("jobs", store.JOBS), ("clips", store.CLIPS), ("history", store.HISTORY)):
        path = fresh(spark, name)
        t = store.create(spark, path, schema)
        if name == "clips":
            store.append(spark.range(1).select(F.col("id").alias("job_id"), F.col("id").alias("clip_index")), path, schema)
            t = store.create(spark, path, schema)
        row = t.agg(F.lit(name).alias("name"), F.lit(len(t.columns)).cast("long").alias("columns"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


CT = "SELECT ct.job_id, ct.clip_index, CASE WHEN ct.job_id % 2 = 0 THEN 0 ELSE start_ms END AS start_ms, end_ms, 'job:' || ct.job_id || ':temporal:' || ct.clip_index AS embedding_path FROM ct"


@query(f"WITH {O.CLIPS} {CT}")
def k5_append_clips(spark, sf_dir):
    """Clip rows appended; a missing start counts as 0; the vector is a key into the cache."""
    path = fresh(spark, "clips")
    store.create(spark, path, store.CLIPS)
    c = C.clip_vectors(frames(spark, sf_dir))
    key = M.key("job", F.col("job_id"), "temporal", F.col("clip_index"))
    rows = c.select("job_id", "clip_index", F.col("start").alias("start_frame"), "end_frame", F.when(F.col("job_id") % 2 != 0, F.col("start_ms")).alias("start_ms"), "end_ms", key.alias("embedding_path"))
    store.append(rows, path, store.CLIPS)
    return store.read(spark, path, store.CLIPS).select("job_id", "clip_index", "start_ms", "end_ms", "embedding_path")


@query(f"WITH {O.A} SELECT job_id, count(*) AS asked, sum(frames_analyzed)::BIGINT AS frames_analyzed, max(query_text) AS last_text FROM (SELECT job_id, seq AS frames_analyzed, answer AS query_text FROM a) GROUP BY 1")
def k6_query_history(spark, sf_dir):
    """Answered queries appended to the history, summed by job."""
    path = fresh(spark, "history")
    store.create(spark, path, store.HISTORY)
    a = answers(spark, sf_dir)
    rows = a.select((F.col("job_id") * 1000 + F.col("seq")).alias("query_id"), "job_id", F.col("answer").alias("query_text"), "answer", F.col("relevance").cast("double").alias("confidence"), F.col("seq").alias("frames_analyzed"))
    store.append(rows, path, store.HISTORY)
    return store.read(spark, path, store.HISTORY).groupBy("job_id").agg(F.count(F.lit(1)).alias("asked"), F.sum("frames_analyzed").alias("frames_analyzed"), F.max("query_text").alias("last_text"))


@query("SELECT 'doc:' || d.doc_id AS key, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE lang END AS value FROM documents AS d LEFT JOIN labels AS l USING (doc_id) WHERE NOT coalesce(l.toxic = 0, false)")
def k8_set_with_ttl(spark, sf_dir):
    """Values without a time to live; of the labelled ones the toxic get a new value that lives, the others one that has
    expired by the time of reading."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.concat(F.lit("doc:"), "doc_id").alias("key")
    kv = d.select(key, F.col("lang").alias("value"), F.lit(None).cast("long").alias("expires_us"))
    now = F.lit(1_700_000_000_000_000)
    kv = store.put(kv, l.where("toxic = 1").select(key, F.lit("toxic").alias("value")), now, 3600)
    kv = store.put(kv, l.where("toxic = 0").select(key, F.lit("clean").alias("value")), now, 60)
    return store.get(kv, now + 60_000_000)


@query("SELECT 'job:' || conv_id || CASE WHEN turn = 0 THEN '' ELSE ':temporal:' || turn END AS key FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def k9_forget_jobs(spark, sf_dir):
    """The rows of a job and all below its key are deleted."""
    key = F.concat(F.lit("job:"), "conv_id", F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit(":temporal:"), "turn")))
    return store.forget(table(spark, sf_dir, "conversations").select(key.alias("key")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id")))


@query("SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'patched' ELSE source END AS source, CASE WHEN toxic = 1 THEN '1' END AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def k10_merge_hash(spark, sf_dir):
    """Maps of fields merged field by field: new values win, other fields stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("old"))
    p = table(spark, sf_dir, "labels").where("toxic = 1").groupBy("doc_id").agg(F.first(F.create_map(F.lit("source"), F.lit("patched"), F.lit("toxic"), F.lit("1"))).alias("new"))
    both = d.join(p, "doc_id", "left").select("doc_id", F.coalesce(store.merged(F.col("old"), F.col("new")), "old").alias("h"))
    return both.select("doc_id", *[F.col("h")[c].alias(c) for c in ("lang", "source", "toxic")])


@query("SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'good' ELSE source END AS source, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END::BIGINT AS updated_at FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) AS l USING (doc_id)")
def k2_update_stamped(spark, sf_dir):
    """A partial update whose rows get the time of the change; repeated patch rows of a key do not multiply its row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(1).cast("long").alias("updated_at"))
    p = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"))
    return jobs.upsert(d, p.unionByName(p), "doc_id", ["source"], stamp=F.lit(2).cast("long"))


@query(f"WITH {O.F} SELECT frame_index, CASE WHEN frame_index % 4 = 0 THEN 0 WHEN frame_index % 4 = 1 THEN 0 ELSE 64 END::BIGINT AS n FROM f")
def k11_vector_cache(spark, sf_dir):
    """Vectors cached as JSON for a week and read back: a quarter has expired, a quarter is corrupt."""
    f = frames(spark, sf_dir)
    key = M.key("embedding", F.col("job_id"), F.col("frame_index"))
    text = F.when(F.col("frame_index") % 4 == 1, F.lit("[0.1, oops")).otherwise(V.to_json(F.col("embedding")))
    expires = F.when(F.col("frame_index") % 4 == 0, store.WEEK).otherwise(2 * store.WEEK).cast("long") * 1_000_000
    cache = store.get(f.select(key.alias("key"), text.alias("value"), expires.alias("expires_us")), F.lit(store.WEEK * 1_000_000).cast("long"))
    got = store.with_cached_vectors(f.select("frame_index", key.alias("embedding_path")), cache).select("frame_index", F.size("embedding").cast("long").alias("n"))
    return f.select("frame_index").join(got, "frame_index", "left").select("frame_index", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {O.CLIPS} SELECT job_id, clip_index, 64::BIGINT AS n FROM cv WHERE clip_index % 3 <> 0 AND job_id <> 2")
def j7_clip_vectors(spark, sf_dir):
    """Clip rows joined with their cached vectors: missing and corrupt ones drop out."""
    c = C.clip_vectors(frames(spark, sf_dir)).withColumn("embedding_path", M.key("job", F.col("job_id"), "temporal", F.col("clip_index")))
    text = F.when(F.col("clip_index") % 3 == 0, F.lit("{}")).otherwise(V.to_json(F.col("embedding")))
    cache = c.where("job_id <> 2").select(F.col("embedding_path").alias("key"), text.alias("value"))
    return store.with_cached_vectors(c.select("job_id", "clip_index", "embedding_path"), cache).select("job_id", "clip_index", F.size("embedding").cast("long").alias("n"))


@query(f"{KEPT}SELECT f.job_id, f.frame_index, kept.frame_index IS NOT NULL AS is_selected, CASE WHEN kept.frame_index IS NOT NULL THEN printf('frame_%06d.jpg', f.frame_index) END AS frame_path FROM f LEFT JOIN kept ON kept.job_id = f.job_id AND kept.frame_index = f.frame_index")
def k14_persist(spark, sf_dir):
    """All frames of every job, the selected ones with the paths of their images."""
    f = frames(spark, sf_dir)
    chosen = selection.select(f, vector_shots(spark, sf_dir), 8, 30, 2000).select("frame_index", F.lit(True).alias("is_selected"), M.frame_path(F.col("frame_index")).alias("frame_path"))
    base = f.select("job_id", "frame_index", F.lit(False).alias("is_selected"), F.lit(None).cast("string").alias("frame_path"))
    return jobs.upsert(base, chosen, "frame_index", ["is_selected", "frame_path"])


@query(f"{KEPT}SELECT 'embedding:' || job_id || ':' || frame_index AS key, 64::BIGINT AS n FROM kept UNION ALL SELECT 'job:' || job_id || ':temporal:' || clip_index, 64 FROM (WITH {O.CLIPS} SELECT job_id, clip_index FROM cv)")
def k15_cache(spark, sf_dir):
    """What a job puts in the cache: the selected frames' vectors and the clips', by key, as JSON."""
    f = frames(spark, sf_dir)
    chosen = selection.select(f, vector_shots(spark, sf_dir), 8, 30, 2000).select("job_id", "frame_index")
    one_ = f.join(chosen, ["job_id", "frame_index"], "left_semi").select(M.key("embedding", F.col("job_id"), F.col("frame_index")).alias("key"), V.to_json(F.col("embedding")).alias("value"))
    two = C.clip_vectors(f).select(M.key("job", F.col("job_id"), "temporal", F.col("clip_index")).alias("key"), V.to_json(F.col("embedding")).alias("value"))
    return one_.unionByName(two).select("key", F.size(V.from_json(F.col("value"))).cast("long").alias("n"))


# checks and small functions


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'format' ELSE 'size' END AS reason, n_chars * 100000 AS bytes, 524288000::BIGINT AS most FROM documents WHERE doc_id % 4 = 3 OR n_chars * 100000 > 524288000")
def p2_refused(spark, sf_dir):
    """The rows that a check refuses, with the reason and the limit; accepted() raises the same reason."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("v."), F.get(F.array(*[F.lit(x) for x in ("mp4", "mkv", "MOV", "gif")]), (F.col("doc_id") % 4).cast("int")))
    size = F.col("n_chars") * 100000
    return d.select("doc_id", M.validity(name, size).alias("reason"), size.alias("bytes"), F.lit(M.MAX_BYTES).cast("long").alias("most")).where("reason IS NOT NULL")


@query("""WITH t AS (SELECT doc_id, length(text) AS n, doc_id % 60 AS k, (doc_id % 13) / 10.0 AS c FROM documents)
SELECT doc_id, CASE WHEN n NOT BETWEEN 1 AND 2000 THEN 'query' WHEN k NOT BETWEEN 1 AND 50 THEN 'max_frames' ELSE 'confidence' END AS field FROM t WHERE n NOT BETWEEN 1 AND 2000 OR k NOT BETWEEN 1 AND 50 OR c > 1.0""")
def p5_rejects(spark, sf_dir):
    """Requests out of range by the first field that is: text of 1 to 2000 characters, 1 to 50 frames, confidence 0 to 1."""
    d = table(spark, sf_dir, "documents")
    k, c = F.col("doc_id") % 60, (F.col("doc_id") % 13) / 10.0
    field = F.when(~F.char_length("text").between(1, 2000), "query").when(~k.between(1, 50), "max_frames").when(~c.between(0.0, 1.0), "confidence")
    return d.select("doc_id", field.alias("field")).where("field IS NOT NULL")


@query("SELECT vec_id AS id, vec_id AS frame_index, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE vec_id * 500 END AS timestamp_ms FROM embeddings")
def p9_index_metadata(spark, sf_dir):
    """Vectors wrapped with a struct of what an index returns for them; a missing time counts as 0."""
    f = frames(spark, sf_dir)
    t = F.when(F.col("frame_index") % 3 != 0, F.col("timestamp_ms"))
    meta = f.select(F.col("frame_index").alias("id"), "embedding", F.struct("frame_index", F.coalesce(t, F.lit(0).cast("long")).alias("timestamp_ms")).alias("meta"))
    return meta.select("id", "meta.frame_index", "meta.timestamp_ms")


@query("""WITH e AS (SELECT user_id AS job_id, event_id % 3 AS channel, CAST(floor(value) AS BIGINT) % 256 AS v FROM events),
c AS (SELECT job_id, channel, v * 64 // 256 AS b, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT job_id, sum(n) AS total FROM c GROUP BY 1)
SELECT job_id, CAST(channel * 64 + b AS BIGINT) AS bin, round(n / (total + 1e-7), 6) AS share FROM c JOIN t USING (job_id)""")
def v5_three_channels(spark, sf_dir):
    """Histograms of three channels, 64 bins each over 0 to 255, one after another and divided by their sum."""
    e = requests(spark, sf_dir).select(F.col("identifier").alias("job_id"), (F.col("event_id") % 3).alias("channel"), (F.floor("value") % 256).cast("int").alias("v"))
    return shots.channel_shares(e).select("job_id", "bin", r6("share").alias("share"))


@query("SELECT p_partkey, CAST(trunc(p_size::DOUBLE / (p_partkey % 30 + 1)::DOUBLE * 1000) AS BIGINT) AS clip_ms, greatest(1, CAST(trunc(p_size::DOUBLE * (1 - (p_partkey % 4)::DOUBLE / 4)) AS BIGINT)) AS stride FROM part")
def t9_clip_arithmetic(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    return p.select("p_partkey", M.clip_ms(size, (F.col("p_partkey") % 30 + 1).cast("double")).alias("clip_ms"), M.clip_stride(size, (F.col("p_partkey") % 4).cast("double") / 4).alias("stride"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso, epoch_us(ts) AS us FROM events")
def t10_iso_times(spark, sf_dir):
    """Times written as text and read back."""
    e = table(spark, sf_dir, "events").select("event_id", M.iso(F.col("ts")).alias("iso"))
    return e.select("event_id", "iso", micros(M.from_iso(F.col("iso"))).alias("us"))


@query("SELECT * FROM (VALUES ('start', 'processing', 0.1::DOUBLE), ('preprocess', 'processing', 0.2::DOUBLE), ('extract', 'extracting', 0.3::DOUBLE), ('cache', 'analyzing', 0.7::DOUBLE), ('finish', 'complete', 1.0::DOUBLE)) AS t(step, status, progress)")
def g18_milestones(spark, sf_dir):
    return spark.createDataFrame(jobs.STEPS, "step string, status string, progress double")


@query(f"WITH {O.F}, {O.clips('seek')}, {O.q()}, nf AS (SELECT job_id, count(*) AS a FROM f GROUP BY 1), nc AS (SELECT job_id, count(*) AS b FROM c GROUP BY 1), k AS (SELECT job_id, least(20, greatest(a, coalesce(b, 0))) AS k FROM nf LEFT JOIN nc USING (job_id)), s AS (SELECT job_id, frame_index, row_number() OVER (PARTITION BY job_id ORDER BY {O.dot('embedding', 'e')} DESC, frame_index) AS rank FROM f, q) SELECT s.job_id, frame_index, rank, k FROM s JOIN k USING (job_id) WHERE rank <= k")
def o6_result_limit(spark, sf_dir):
    """The k best of each job, k the least of the wanted 20 and the longer of its two streams."""
    f = frames(spark, sf_dir)
    spatial, temporal = f.groupBy("job_id").agg(F.count(F.lit(1)).alias("a")), C.clips(f).groupBy("job_id").agg(F.count(F.lit(1)).alias("b"))
    k = spatial.join(temporal, "job_id", "left").select("job_id", F.least(F.lit(20), F.greatest("a", F.coalesce("b", F.lit(0)))).cast("long").alias("k"))
    ranked = search.rank_all(f, one(spark, sf_dir)).join(k, "job_id").where(F.col("rank") <= F.col("k"))
    return ranked.select("job_id", "frame_index", F.col("rank").cast("long").alias("rank"), "k")


@query("SELECT vec_id AS id, 'spatial' AS stream FROM embeddings UNION ALL SELECT (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY item_id) - 1, 'temporal' FROM benchmark WHERE item_id % 3 <> 1")
def u4_ids_continue(spark, sf_dir):
    """A second batch, whose own ids have gaps, is numbered on from the first."""
    f = frames(spark, sf_dir)
    second = store.numbered(table(spark, sf_dir, "benchmark").where("item_id % 3 <> 1").select("item_id"), "item_id", "id", f.count())
    return f.select(F.col("frame_index").alias("id"), F.lit("spatial").alias("stream")).unionByName(second.select("id", F.lit("temporal").alias("stream")))


@query(f"WITH {O.CLIPS}, {O.lists(10, 10)} SELECT id, round(2 * score, 6) AS score, (SELECT count(*) FROM f) AS n_spatial, (SELECT count(*) FROM cv) AS n_temporal FROM te")
def u5_one_stream(spark, sf_dir):
    """A tagged index of both streams: its counts, and a search of one of them."""
    f = frames(spark, sf_dir)
    clips = C.clip_vectors(f).select(F.lit("temporal").alias("stream"), (F.col("job_id") * 1000 + F.col("clip_index")).alias("id"), "embedding")
    index = f.select(F.lit("spatial").alias("stream"), F.col("frame_index").alias("id"), "embedding").unionByName(clips)
    counts = index.groupBy().agg(F.count_if(F.col("stream") == "spatial").alias("n_spatial"), F.count_if(F.col("stream") == "temporal").alias("n_temporal"))
    found = search.top_k(index.where("stream = 'temporal'"), one(spark, sf_dir), 10, "id").select("id", r6("score").alias("score"))
    return found.crossJoin(F.broadcast(counts))


F16 = "f AS (SELECT CAST(label AS BIGINT) AS job_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 500 AS timestamp_ms, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


@query(O.ORACLES["g6_select"].replace(O.F, F16))
def g16_select_from_frames(spark, sf_dir):
    """Selection from frames that come without ids and times."""
    given = frames(spark, sf_dir).select("job_id", F.col("frame_index").alias("arrived"), "embedding")
    cut = lambda f: shots.boundaries(f, 0.3, 3, True, "embedding", "frame_index", lambda a, b: 1 - V.dot(a, b))
    return selection.from_frames(given, "arrived", 8, 30, 2000, boundaries=cut)


# ordered encoding


@query("WITH t AS (SELECT user_id AS identifier, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), c AS (SELECT user_id AS identifier, count(*) AS total FROM events GROUP BY 1) SELECT identifier, n // 32 AS batch, n % 32 AS place, event_id, total - n // 32 * 32 < 32 AS is_partial FROM t JOIN c USING (identifier)")
def x3_batches(spark, sf_dir):
    """Batches of 32 in order; a stream's last one may be partial."""
    r = requests(spark, sf_dir).select("identifier", "event_id")
    b = streams.batches(r, "identifier", "event_id", 32)
    size = F.count(F.lit(1)).over(Window.partitionBy("identifier", "batch"))
    return b.select("identifier", "batch", "place", "event_id", (size < 32).alias("is_partial"))


@query("SELECT user_id AS identifier, event_id, 2 * value AS value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 32 AS batch FROM events")
def x4_encode_in_order(spark, sf_dir):
    """Values encoded batch by batch; every result keeps its place."""
    r = requests(spark, sf_dir).select("identifier", "event_id", "value")
    return streams.encode(r, "identifier", "event_id", "value", 32, lambda v: 2 * v)


@query(f"WITH {O.CLIPS}, {O.lists(10, 10)} SELECT 'both' AS run, stream, id, round(score, 6) AS score FROM (FROM sp UNION ALL FROM te) UNION ALL SELECT 'one', stream, id, round(score, 6) FROM sp")
def x5_a_stream_fails(spark, sf_dir):
    """Two streams fused, and again with a temporal one that fails: its results are missing, the others stay."""
    f, q = frames(spark, sf_dir), one(spark, sf_dir)
    clips = C.clip_vectors(f).withColumn("id", F.col("job_id") * 1000 + F.col("clip_index"))
    spatial, out = search.top_k(f, q, 10).withColumnRenamed("frame_index", "id"), None
    broken = clips.withColumn("id", F.when(F.col("job_id") == 3, F.raise_error(F.lit("the encoder failed")).cast("long")).otherwise(F.col("id")))
    for run, c in (("both", clips), ("one", broken)):
        needed, other = streams.either(spatial, lambda c=c: search.top_k(c, q, 10, "id"), fresh(spark, "temporal"))
        got = search.fused(needed, other, 10, 0.5).select(F.lit(run).alias("run"), "stream", "id", r6("score").alias("score"))
        out = got if out is None else out.unionByName(got)
    return out

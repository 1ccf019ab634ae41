"""Further registered queries: scans, sinks, lookups and aggregates of the survey that are single steps; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotlake.functions import media as M
from shotlake.functions import vectors as V
from shotlake.operators import clips as C
from shotlake.operators import cluster, jobs, plugins, search, selection
from shotlake.plans import oracles as O
from shotlake.plans.queries import answers, fused_lists, one, r6, requested, vector_shots
from shotlake.sources.tables import frames, ordinals, requests, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("SELECT vec_id AS frame_index, vec_id * 500 AS timestamp_ms FROM embeddings WHERE label = 3")
def s9_job_scan(spark, sf_dir):
    """An equality filter that reaches the scan, and the two columns it needs."""
    return frames(spark, sf_dir).where("job_id = 3").select("frame_index", "timestamp_ms")


@query(f"WITH {O.F}, {O.clips('seek')} SELECT clip_index, CAST(start AS BIGINT) AS start FROM c WHERE job_id = 3 ORDER BY clip_index")
def s10_job_clips(spark, sf_dir):
    return C.clips(frames(spark, sf_dir)).where("job_id = 3").select("clip_index", "start").orderBy("clip_index")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def s12_kv_get(spark, sf_dir):
    """JSON values; bad JSON gives null."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.lit("{bad")).otherwise(F.col("props"))
    return e.select("event_id", F.from_json(text, "k bigint")["k"].alias("k"))


@query("SELECT conv_id AS job_id, count(*) AS n, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS ids FROM conversations WHERE starts_with('job:' || conv_id || ':temporal:' || turn, 'job:1') GROUP BY conv_id")
def s13_prefix_scan(spark, sf_dir):
    key = M.key("job", F.col("conv_id"), "temporal", F.col("turn"))
    c = table(spark, sf_dir, "conversations").select(key.alias("key")).where(F.col("key").startswith("job:1"))
    c = c.select(M.key_part(F.col("key"), 1).cast("long").alias("job_id"), M.key_part(F.col("key"), 3).cast("long").alias("id"))
    ids = F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))
    return c.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, ",").alias("ids"))


@query("SELECT vec_id AS frame_index, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE vec_id * 500 END AS timestamp_ms, false AS is_selected FROM embeddings UNION ALL SELECT vec_id + 100000, vec_id * 500, true FROM embeddings WHERE vec_id < 10")
def k3_append_vectors(spark, sf_dir):
    """An append whose missing columns get their defaults."""
    f = frames(spark, sf_dir)
    old = f.select("frame_index", F.when(F.col("frame_index") % 4 != 0, F.col("timestamp_ms")).alias("timestamp_ms"), F.lit(None).cast("boolean").alias("is_selected"))
    new = f.where("frame_index < 10").select((F.col("frame_index") + 100000).alias("frame_index"), "timestamp_ms", F.lit(True).alias("is_selected"))
    return old.unionByName(new).select("frame_index", F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms"), F.coalesce("is_selected", F.lit(False)).alias("is_selected"))


@query("SELECT doc_id, coalesce(l.source, d.source) AS source FROM documents AS d FULL JOIN (SELECT doc_id, 'patched' AS source FROM labels WHERE toxic = 1) AS l USING (doc_id)")
def k10_field_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    p = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("patched").alias("source"))
    return jobs.upsert(d, p, "doc_id", ["source"], insert=True)


@query("SELECT CASE WHEN n_chars * 100000 > 524288000 THEN 'size' ELSE '-' END AS reason, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def p2_quarantine(spark, sf_dir):
    """Rows by their first failed check."""
    d = table(spark, sf_dir, "documents")
    reason = F.coalesce(M.validity(F.lit("x/y.mp4"), F.col("n_chars") * 100000), F.lit("-"))
    return d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("SELECT page_id, lower(['MP4', 'Mov', 'exe'][page_id % 3 + 1]) AS extension, page_id % 3 < 2 AND strlen(html) * 20000 <= 524288000 AS accepted FROM pages")
def p3_upload_gate(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("upload."), F.get(F.array(F.lit("MP4"), F.lit("Mov"), F.lit("exe")), (F.col("page_id") % 3).cast("int")))
    return p.select("page_id", M.extension(name).alias("extension"), M.validity(name, F.octet_length("html") * 20000).isNull().alias("accepted"))


@query("SELECT vec_id AS frame_index FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def p6_keep_selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("frame_index"))
    return frames(spark, sf_dir).select("frame_index").join(chosen, "frame_index", "left_semi")


@query(f"WITH RECURSIVE {O.FOLD} SELECT a.conv_id AS job_id, count(*) AS n FROM conversations AS a JOIN fin ON fin.job_id = a.conv_id AND status = 'complete' GROUP BY 1")
def p8_ready_guard(spark, sf_dir):
    ready = jobs.fold_states(requested(spark, sf_dir)).where("status = 'complete'").select("job_id")
    return answers(spark, sf_dir).join(ready, "job_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.S0}, t AS (SELECT * FROM s ORDER BY score DESC, frame_index LIMIT 10) SELECT frame_index, CASE WHEN frame_index % 3 = 0 THEN 0 ELSE timestamp_ms END AS timestamp_ms, job_id FROM t")
def j1_hits_to_rows(spark, sf_dir):
    """Top ids joined back to their rows; a missing time counts as 0."""
    f = frames(spark, sf_dir)
    rows = f.select("frame_index", "job_id", F.when(F.col("frame_index") % 3 != 0, F.col("timestamp_ms")).alias("t"))
    hits = search.top_k(f, one(spark, sf_dir), 10)
    return hits.join(rows, "frame_index", "left").select("frame_index", F.coalesce("t", F.lit(0)).alias("timestamp_ms"), "job_id")


@query(f"WITH RECURSIVE {O.VS} SELECT f.job_id, f.frame_index, b.pos IS NOT NULL AS is_boundary FROM f LEFT JOIN b ON b.job_id = f.job_id AND b.frame_index = f.frame_index")
def j3_boundary_flag(spark, sf_dir):
    b = vector_shots(spark, sf_dir).select("job_id", "frame_index", F.lit(True).alias("b"))
    return frames(spark, sf_dir).select("job_id", "frame_index").join(b, ["job_id", "frame_index"], "left").select("job_id", "frame_index", F.coalesce("b", F.lit(False)).alias("is_boundary"))


@query(f"WITH RECURSIVE {O.candidates(15, 5)} SELECT f.job_id, f.frame_index FROM f ANTI JOIN ca ON ca.job_id = f.job_id AND ca.frame_index = f.frame_index")
def u3_remaining(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("job_id", "frame_index").join(selection.candidates(f, vector_shots(spark, sf_dir), 15, 5), ["job_id", "frame_index"], "left_anti")


@query(f"WITH {O.S0} SELECT job_id, round(min(score), 6) AS low, round(max(score), 6) AS high, arg_max(frame_index, score) AS best, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, max(timestamp_ms) - min(timestamp_ms) + 1 AS span_ms FROM s GROUP BY job_id")
def a2_extremes(spark, sf_dir):
    s = search.scored(frames(spark, sf_dir), one(spark, sf_dir))
    first, last = F.min("timestamp_ms"), F.max("timestamp_ms")
    best = F.max(F.struct("score", (-F.col("frame_index")).alias("m")))
    return s.groupBy("job_id").agg(r6(F.min("score")).alias("low"), r6(F.max("score")).alias("high"), (-best["m"]).alias("best"), first.alias("first_ms"), last.alias("last_ms"), (last - first + 1).alias("span_ms"))


@query(f"WITH {O.F} SELECT a.job_id, a.frame_index, round(avg(1 - {O.cosine('a.embedding', 'b.embedding')}), 6) AS mean_distance FROM f AS a JOIN f AS b USING (job_id) GROUP BY 1, 2")
def a4_mean_distance(spark, sf_dir):
    """Mean distance to all frames of the job, itself included: 1 less the product with the mean of the unit vectors, so
    no pairs are made."""
    unit = frames(spark, sf_dir).select("job_id", "frame_index", V.normalise(F.col("embedding")).alias("embedding"))
    mean = cluster.centres(unit, "job_id")
    return unit.join(mean, "job_id").select("job_id", "frame_index", r6(1 - V.dot(F.col("embedding"), F.col("centre"))).alias("mean_distance"))


@query("SELECT user_id AS job_id, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) AS n FROM events GROUP BY 1")
def a12_success_count(spark, sf_dir):
    e = requests(spark, sf_dir)
    return e.groupBy(F.col("identifier").alias("job_id")).agg(F.count_if(F.col("event_type") != "error").alias("succeeded"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.O} SELECT job_id, n // 8 AS batch, count(*) AS size, min(frame_index) AS first FROM o GROUP BY 1, 2")
def w10_batches(spark, sf_dir):
    """Fixed-size batches of a job's frames, numbered from 0."""
    o = ordinals(frames(spark, sf_dir))
    return o.groupBy("job_id", F.floor(F.col("n") / 8).alias("batch")).agg(F.count(F.lit(1)).alias("size"), F.min("frame_index").alias("first"))


@query(f"WITH {O.F}, {O.q(7)}, s AS (SELECT frame_index, {O.dot('embedding', 'e')} / ((sqrt({O.dot('embedding', 'embedding')}) + 1e-7) * (sqrt({O.dot('e', 'e')}) + 1e-7)) AS sc FROM f, q) SELECT frame_index, round(sc, 6) AS score FROM s ORDER BY sc DESC, frame_index LIMIT 10")
def o3_flat_inner_product(spark, sf_dir):
    """Top-k by inner product over a column that was normalised when it was written."""
    f = frames(spark, sf_dir).withColumn("embedding", V.normalise(F.col("embedding")))
    q = one(spark, sf_dir, 7).select(V.normalise(F.col("q")).alias("q"))
    return search.top_k(f, q, 10, plain=True).select("frame_index", r6("score").alias("score"))


@query(f"WITH {O.S0}, n AS (SELECT count(*) AS c FROM f WHERE job_id = 2), t AS (SELECT * FROM s WHERE job_id = 2 ORDER BY score DESC, frame_index LIMIT 50) SELECT frame_index FROM (SELECT *, row_number() OVER (ORDER BY score DESC, frame_index) AS r FROM t) WHERE r <= least(50, (SELECT c FROM n)) ORDER BY frame_index")
def o6_limit_and_resort(spark, sf_dir):
    """The k best of a job, at most as many as it has, in order of time."""
    f = frames(spark, sf_dir).where("job_id = 2")
    return search.top_k(f, one(spark, sf_dir), 50).select("frame_index").orderBy("frame_index")


@query("SELECT vec_id AS id, 'spatial' AS stream FROM embeddings UNION ALL SELECT (SELECT count(*) FROM embeddings) + item_id, 'temporal' FROM benchmark")
def u4_append_ids(spark, sf_dir):
    """Two streams under one sequence of ids: the second continues after the first."""
    f, b = frames(spark, sf_dir), table(spark, sf_dir, "benchmark")
    n = f.agg(F.count(F.lit(1)).alias("n"))
    second = b.crossJoin(F.broadcast(n)).select((F.col("n") + F.col("item_id")).alias("id"), F.lit("temporal").alias("stream"))
    return f.select(F.col("frame_index").alias("id"), F.lit("spatial").alias("stream")).unionByName(second)


@query(f"WITH {O.CLIPS}, {O.lists(10, 10)} SELECT stream, count(*) AS n FROM (FROM sp UNION ALL FROM te) GROUP BY stream")
def u5_stream_counts(spark, sf_dir):
    s, t = fused_lists(spark, sf_dir)
    return search.fused(s, t, 10).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.A} SELECT job_id, seq, CAST(0.8 AS DOUBLE) AS confidence, round(1.0 / count(*) OVER (PARTITION BY job_id), 6) AS weight FROM a")
def g10_batch_structure(spark, sf_dir):
    n = F.count(F.lit(1)).over(Window.partitionBy("job_id"))
    return answers(spark, sf_dir).select("job_id", "seq", F.lit(0.8).alias("confidence"), r6(1.0 / n).alias("weight"))


@query(
    O.ORACLES["g6_select"].replace("SELECT job_id, frame_index, timestamp_ms FROM kept", "")
    + f", {O.clips('seek')}, kk AS (SELECT job_id, count(*) AS n_selected FROM kept GROUP BY 1), cc AS (SELECT job_id, count(*) AS n_clips FROM c GROUP BY 1), bb AS (SELECT job_id, count(*) AS n_shots FROM b GROUP BY 1) SELECT kk.job_id, n_selected, coalesce(n_clips, 0) AS n_clips, coalesce(n_shots, 0) AS n_shots, 'complete' AS status, CAST(1.0 AS DOUBLE) AS progress FROM kk LEFT JOIN cc USING (job_id) LEFT JOIN bb USING (job_id)"
)
def g15_process(spark, sf_dir):
    """The ingest path of every job: shots, selection and clips, then its final state."""
    f, b = frames(spark, sf_dir), vector_shots(spark, sf_dir)
    count = lambda df, name: df.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))
    out = count(selection.select(f, b, 8, 30, 2000), "n_selected").join(count(C.clips(f), "n_clips"), "job_id", "left").join(count(b, "n_shots"), "job_id", "left")
    done = F.lit("complete")
    return out.select("job_id", "n_selected", F.coalesce("n_clips", F.lit(0)).alias("n_clips"), F.coalesce("n_shots", F.lit(0)).alias("n_shots"), done.alias("status"), jobs.mapped(jobs.MILESTONES, done, 0.0).alias("progress"))


@query("SELECT item_id, unnest(range(0, 16)) AS pos, unnest([CAST(len(list_filter(d, lambda x: x = c)) AS DOUBLE) for c in ['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f']]) AS x FROM (SELECT item_id, [substr(md5(w), 1, 1) for w in string_split(lower(text), ' ') if w <> ''] AS d FROM benchmark)")
def f2_text_encode(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(plugins.encode_text(F.col("text"))).alias("pos", "x"))
    return b.select("item_id", F.col("pos").cast("long").alias("pos"), "x")


@query(f"WITH {O.F} SELECT frame_index, round(2 * list_sum(embedding), 6) AS total FROM f")
def f4_batch_encode(spark, sf_dir):
    """A batch function over Arrow matrices; row order and ids are kept."""
    f = frames(spark, sf_dir).select("frame_index", "embedding")
    return plugins.batch_map(f, "embedding", lambda m: 2 * m).select("frame_index", r6(V.total(F.col("embedding"))).alias("total"))


@query(None)
def g8_kmeans(spark, sf_dir):
    """Library k-means: sizes and medoids of eight clusters; the labels have no SQL counterpart."""
    k = cluster.k_means(frames(spark, sf_dir), 8)
    return cluster.medoids(k, "cluster").select("cluster", "medoid", "size")

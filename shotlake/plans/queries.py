"""Registered queries over the provided tables, by the identifiers of the survey."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlake.functions import media as M
from shotlake.functions import vectors as V
from shotlake.operators import clips as C
from shotlake.operators import cluster, jobs, limits, responses, search, selection, shots
from shotlake.session import shared_folder
from shotlake.sources.tables import frames, histograms, ordinals, requests, table
from shotlake.streaming import state

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c):
    return F.round(c, 6)


def one(spark: SparkSession, sf_dir: str, id: int = 0) -> DataFrame:
    """The vector of one frame as a query."""
    return frames(spark, sf_dir).where(F.col("frame_index") == id).select(F.col("embedding").alias("q"))


#: Identifier and status or request that an event type stands for.
REQUESTED = {"view": "processing", "click": "extracting", "signup": "analyzing", "purchase": "complete", "error": "failed"}
HOURS6 = 6 * 3600 * 1_000_000


def requested(spark, sf_dir):
    e = requests(spark, sf_dir)
    return e.select(F.col("identifier").alias("job_id"), F.col("event_id").alias("seq"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "retry").otherwise(jobs.mapped(REQUESTED, F.col("event_type"), "cancelled")).alias("requested"))


def answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), (F.col("turn") * 1000).alias("timestamp_ms"), F.col("turn").alias("seq"), F.col("text").alias("answer"), (1.0 / (F.col("turn") + 1)).alias("relevance"))


def vector_shots(spark, sf_dir):
    """Boundaries of the vector jobs: distance 1 - dot of neighbours, fixed gap of 3."""
    return shots.boundaries(frames(spark, sf_dir), 0.3, 3, True, "embedding", "frame_index", lambda a, b: 1 - V.dot(a, b))


# vectors


@query
def v1_cosine(spark, sf_dir):
    s = search.scored(frames(spark, sf_dir), one(spark, sf_dir))
    return s.select("frame_index", r6("score").alias("score"))


@query
def v2_normalise_norms(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("twice", F.transform("embedding", lambda x: 2 * x))
    return f.select("frame_index", r6(V.norm(F.col("twice"))).alias("norm"), r6(V.norm(V.normalise(F.col("twice")))).alias("unit_norm"))


@query
def v3_dot(spark, sf_dir):
    return search.scored(frames(spark, sf_dir), one(spark, sf_dir, 1), plain=True).select("frame_index", r6("score").alias("score"))


@query
def v4_chi2_pairs(spark, sf_dir):
    h = histograms(spark, sf_dir)
    a = h.select("job_id", F.col("frame_index").alias("a"), F.col("hist").alias("x"))
    b = h.select("job_id", F.col("frame_index").alias("b"), F.col("hist").alias("y"))
    return a.join(b, "job_id").where("a < b").select("job_id", "a", "b", r6(V.chi_squared(F.col("x"), F.col("y"))).alias("distance"))


@query
def v5_histogram(spark, sf_dir):
    h = histograms(spark, sf_dir).select("job_id", "frame_index", F.posexplode("hist").alias("bin", "share"))
    return h.select("job_id", "frame_index", F.col("bin").cast("long").alias("bin"), r6("share").alias("share"))


@query
def v5_channel_bins(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value >= 0 AND value < 256")
    return e.groupBy(V.bin_of(F.col("value")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query
def v6_fingerprint(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_index", V.fingerprint(F.col("embedding")).alias("fingerprint"), V.full_fingerprint(F.col("embedding")).alias("full"))


@query
def v7_json_roundtrip(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("back", V.from_json(V.to_json(F.col("embedding"))))
    return f.select("frame_index", F.size("back").cast("long").alias("n"), (F.col("back") == F.col("embedding")).alias("same"))


@query
def v8_minmax(spark, sf_dir):
    w = Window.partitionBy("job_id")
    s = search.scored(frames(spark, sf_dir), one(spark, sf_dir))
    return s.select("frame_index", r6(V.min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))).alias("scaled"))


@query
def v9_distance(spark, sf_dir):
    return search.scored(frames(spark, sf_dir), one(spark, sf_dir)).select("frame_index", r6(1 - F.col("score")).alias("distance"))


# search


@query
def o2_topk(spark, sf_dir):
    return search.top_k(frames(spark, sf_dir), one(spark, sf_dir), 10).select("frame_index", r6("score").alias("score"))


@query
def o4_rank_all(spark, sf_dir):
    return search.rank_all(frames(spark, sf_dir), one(spark, sf_dir, 3)).select("job_id", "frame_index", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query
def o8_multi_topk(spark, sf_dir):
    f = frames(spark, sf_dir)
    q = f.where("frame_index % 20 = 0").select(F.col("frame_index").alias("query_id"), F.col("embedding").alias("q"))
    return search.multi_top_k(f, q, 5).select("query_id", "frame_index", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query
def j6_pairs_in_label(spark, sf_dir):
    return search.pairs(frames(spark, sf_dir)).select("job_id", "a", "b", r6("score").alias("score"))


def fused_lists(spark, sf_dir, k=10):
    f, q = frames(spark, sf_dir), one(spark, sf_dir)
    clips = C.clip_vectors(f).withColumn("id", F.col("job_id") * 1000 + F.col("clip_index"))
    spatial = search.top_k(f, q, k).withColumnRenamed("frame_index", "id")
    return spatial, search.top_k(clips, q, k, "id")


@query
def u1_fused(spark, sf_dir):
    return search.fused(*fused_lists(spark, sf_dir), 10, 0.5).select("stream", "id", r6("score").alias("score"))


@query
def u1_fused_no_temporal(spark, sf_dir):
    return search.fused(fused_lists(spark, sf_dir)[0], None, 10, 0.5).select("stream", "id", r6("score").alias("score"))


@query
def j11_clip_to_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    c = C.clip_vectors(f).select("job_id", "clip_index", "start_ms", "end_ms")
    return search.clip_frames(c, f).select("job_id", "clip_index", "frame_index")


# clips and sampling

#: Clips of a job that the temporal encoder asks for at most.
MAX_CLIPS = 500


@query
def w2_clips_seek(spark, sf_dir):
    return C.clips(frames(spark, sf_dir), max_clips=MAX_CLIPS)


@query
def w3_clips_batch(spark, sf_dir):
    return C.clips(frames(spark, sf_dir), mode="batch", max_clips=MAX_CLIPS)


@query
def a13_clip_pool(spark, sf_dir):
    c = C.clip_vectors(frames(spark, sf_dir)).select("job_id", "clip_index", F.posexplode("embedding").alias("pos", "x"))
    return c.select("job_id", "clip_index", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


def event_frames(spark, sf_dir):
    e = requests(spark, sf_dir).select(F.col("identifier").alias("job_id"), F.col("event_id").alias("frame_index"))
    return ordinals(e)


@query
def s1_stride_sample(spark, sf_dir):
    s = C.stride_sample(event_frames(spark, sf_dir), F.when(F.col("job_id") % 5 == 0, 0.0).otherwise(F.lit(7.0)), 2.0, 15)
    return s.select("job_id", "n", "frame_index", "timestamp_ms")


@query
def s3_seek_by_ms(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    times = f.select("job_id").distinct().select("job_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 467, 1000, 5000, 900000)])).alias("ms"))
    return C.seek(f.select("job_id", "n", "frame_index"), times, 29.97).select("job_id", "ms", "n", "frame_index")


@query
def o5_frame_cap(spark, sf_dir):
    w = Window.partitionBy("job_id").orderBy("frame_index")
    e = requests(spark, sf_dir).select(F.col("identifier").alias("job_id"), F.col("event_id").alias("frame_index"))
    return e.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")


@query
def s8_probe(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    fps = F.when(F.col("page_id") % 7 == 0, 0.0).otherwise(24.0 + F.col("page_id") % 7)
    code = F.lit(828601953).cast("int")
    return p.select("page_id", F.when(fps > 0, (F.char_length("html") / fps * 1000).cast("long")).otherwise(F.lit(0)).alias("duration_ms"), M.codec_name(code).alias("codec"))


# labels, paths, checks


@query
def t1_timestamp_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.label_ms(F.col("event_id") * 977).alias("label"))


@query
def t2_mmss(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.label_mmss(F.col("event_id") * 977).alias("label"))


@query
def t3_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.extension(F.regexp_replace("url", "[?#].*$", "")).alias("extension"))


@query
def t5_path_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.clean_path(F.concat(F.lit("//../"), F.regexp_replace("url", "^[a-z]+:/", ""), F.lit("/../x"))).alias("path"))


@query
def t6_url_parts(spark, sf_dir):
    u = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.when(F.col("page_id") % 2 == 0, F.lit(":6380")).otherwise(""), F.when(F.col("page_id") % 3 == 0, F.lit("/4")).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", M.url_part(u, "host").alias("host"), M.url_part(u, "port").cast("long").alias("port"), M.url_part(u, "db").cast("long").alias("db"))


@query
def t7_keys(spark, sf_dir):
    k = M.key("job", F.col("conv_id"), "temporal", F.col("turn"))
    return table(spark, sf_dir, "conversations").select(k.alias("key"), M.key_part(k, 1).cast("long").alias("job_id"), M.key_part(k, 3).cast("long").alias("n"))


@query
def t8_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = M.media_ms(F.col("event_id"), F.lit(30.0))
    return e.select("event_id", ms.alias("ms"), M.frame_at(ms, F.lit(30.0)).alias("back"))


@query
def t12_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    return jobs.live(e, now, "ts", 7 * 86400).select("event_id")


@query
def t13_data_url(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", M.data_url(F.col("text").cast("binary")).alias("url"))


@query
def k12_frame_path(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_index", M.frame_path(F.col("frame_index")).alias("path"))


@query
def p1_validate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ext = F.get(F.array(*[F.lit(x) for x in ("mp4", "MKV", "txt", "webm", "")]), (F.col("doc_id") % 5).cast("int"))
    name = F.concat(F.lit("clip."), ext)
    reason = M.validity(name, F.col("n_chars") * 100000, F.col("doc_id") % 11 != 0)
    return d.select("doc_id", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("-")).alias("reason"))


@query
def p4_needs_preprocess(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("a/b.c/clip."), F.get(F.array(*[F.lit(x) for x in ("mp4", "mkv", "M4V")]), (F.col("doc_id") % 3).cast("int")))
    return d.select("doc_id", M.needs_preprocessing(name, F.col("n_chars"), F.col("n_chars") % 2000).alias("needs"))


@query
def p5_constraints(spark, sf_dir):
    b = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 60
    ok = F.char_length("text").between(1, 2000) & k.between(1, 50)
    return b.select("doc_id", ok.alias("ok"))


@query
def p7_terminal(spark, sf_dir):
    return requested(spark, sf_dir).where(F.col("requested").isin(*jobs.TERMINAL)).groupBy("requested").agg(F.count(F.lit(1)).alias("n"))


# shots


@query
def w1_hist_distance(spark, sf_dir):
    return shots.consecutive_distance(histograms(spark, sf_dir)).select("job_id", "pos", "frame_index", r6("distance").alias("distance"))


@query
def a1_threshold(spark, sf_dir):
    d = shots.with_threshold(shots.consecutive_distance(histograms(spark, sf_dir)))
    return d.groupBy("job_id").agg(r6(F.max("threshold")).alias("threshold"))


@query
def g1_shots(spark, sf_dir):
    b = shots.boundaries(histograms(spark, sf_dir), 0.1, 3)
    return b.select("job_id", "pos", "frame_index", r6("confidence").alias("confidence"))


@query
def g1_shots_fixed(spark, sf_dir):
    b = shots.boundaries(histograms(spark, sf_dir), 0.3, 1, adaptive=False)
    return b.select("job_id", "pos", "frame_index", r6("confidence").alias("confidence"))


@query
def g2_gap_filter(spark, sf_dir):
    return shots.gap_filter(requests(spark, sf_dir), ["identifier"], "us", HOURS6 // 6, ["event_id"]).select("identifier", "us", "event_id")


# selection


@query
def w4_temporal_score(spark, sf_dir):
    p = selection.with_position(frames(spark, sf_dir))
    return p.select("frame_index", r6("position").alias("position"), r6("temporal_score").alias("temporal_score"))


@query
def g5_score(spark, sf_dir):
    f = search.scored(frames(spark, sf_dir), one(spark, sf_dir), plain=True)
    return selection.scores(f, vector_shots(spark, sf_dir), "score").select("job_id", "frame_index", r6("score").alias("score"))


@query
def g4_diverse(spark, sf_dir):
    return selection.diverse(frames(spark, sf_dir), 6)


@query
def u2_candidates(spark, sf_dir):
    c = selection.candidates(frames(spark, sf_dir), vector_shots(spark, sf_dir), 15, 5)
    return c.select("job_id", "frame_index", F.col("source").cast("long").alias("source"), "left")


@query
def g6_select(spark, sf_dir):
    return selection.select(frames(spark, sf_dir), vector_shots(spark, sf_dir), 8, 30, 2000)


@query
def g7_frame_rows(spark, sf_dir):
    b = vector_shots(spark, sf_dir)
    return selection.frame_rows(selection.select(frames(spark, sf_dir), b, 8, 30, 2000), b)


# requests and jobs


@query
def w5_rate_limit(spark, sf_dir):
    return limits.rate_limit(requests(spark, sf_dir), 3, HOURS6)


@query
def w6_rate_info(spark, sf_dir):
    return limits.rate_info(requests(spark, sf_dir), 3, HOURS6)


@query
def j9_transitions(spark, sf_dir):
    w = Window.partitionBy("job_id").orderBy("seq")
    r = requested(spark, sf_dir).withColumn("before", F.coalesce(F.lag("requested").over(w), F.lit("pending")))
    e = jobs.edge_table(spark).select(F.col("from_status").alias("before"), F.col("to_status").alias("requested"), F.lit(True).alias("edge"))
    return r.join(F.broadcast(e), ["before", "requested"], "left").select("job_id", "seq", F.coalesce("edge", F.lit(False)).alias("legal"))


@query
def g11_state_fold(spark, sf_dir):
    return jobs.fold_states(requested(spark, sf_dir))


@query
def g12_progress(spark, sf_dir):
    return jobs.progress_view(jobs.fold_states(requested(spark, sf_dir)).select("job_id", "status"))


@query
def w9_retries(spark, sf_dir):
    return jobs.retry_counter(requested(spark, sf_dir)).select("job_id", "seq", "attempt", "may_retry")


def patch(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("good")).alias("source"))


@query
def k2_upsert(spark, sf_dir):
    return jobs.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), patch(spark, sf_dir), "doc_id", ["source"])


@query
def k4_path_update(spark, sf_dir):
    chosen = frames(spark, sf_dir).where("frame_index % 4 = 0").select("frame_index", F.lit(True).alias("is_selected"), M.frame_path(F.col("frame_index")).alias("frame_path"))
    base = frames(spark, sf_dir).select("job_id", "frame_index", F.lit(False).alias("is_selected"), F.lit(None).cast("string").alias("frame_path"))
    return jobs.upsert(base, chosen, "frame_index", ["is_selected", "frame_path"])


@query
def k9_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").select("doc_id", "lang")


@query
def d4_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    return jobs.latest(li, ["l_orderkey"], "l_linenumber").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey")


@query
def a6_counts(spark, sf_dir):
    f = frames(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_frames"))
    c = C.clips(frames(spark, sf_dir)).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_clips"))
    b = vector_shots(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_shots"))
    return f.join(c, "job_id", "left").join(b, "job_id", "left").select("job_id", "n_frames", F.coalesce("n_clips", F.lit(0)).alias("n_clips"), F.coalesce("n_shots", F.lit(0)).alias("n_shots"))


# answers


@query
def g9_list(spark, sf_dir):
    return responses.aggregate(answers(spark, sf_dir), "list").select("job_id", "answer", r6("confidence").alias("confidence"), "n")


@query
def g9_synthesize(spark, sf_dir):
    return responses.aggregate(answers(spark, sf_dir), "synthesize").select("job_id", "answer", r6("confidence").alias("confidence"), "n")


@query
def g9_concat(spark, sf_dir):
    return responses.aggregate(answers(spark, sf_dir), "vote").select("job_id", "answer", r6("confidence").alias("confidence"), "n")


@query
def a10_equal_weight(spark, sf_dir):
    return responses.sources(answers(spark, sf_dir)).select("job_id", "seq", r6("weight").alias("weight"), "description")


@query
def g13_analysis(spark, sf_dir):
    return responses.prompt(answers(spark, sf_dir), "analysis", "What happens?")


@query
def g13_summary(spark, sf_dir):
    return responses.prompt(answers(spark, sf_dir), "summary", "")


@query
def g13_comparison(spark, sf_dir):
    return responses.prompt(answers(spark, sf_dir), "comparison", "mood")


# the whole path, clusters, streams


@query
def g14_query_path(spark, sf_dir):
    """Jobs that are ready, fused hits of a query, their frames (clips by time), at most twelve a query."""
    complete = jobs.fold_states(requested(spark, sf_dir)).where("status = 'complete'").select("job_id")
    ready = frames(spark, sf_dir).join(complete, "job_id", "left_semi")
    q = one(spark, sf_dir)
    clips = C.clip_vectors(ready).withColumn("id", F.col("job_id") * 1000 + F.col("clip_index"))
    hits = search.fused(search.top_k(ready, q, 8).withColumnRenamed("frame_index", "id"), search.top_k(clips, q, 4, "id"), 8)
    spans = clips.select("id", "job_id", "start_ms", "end_ms")
    of_clips = search.clip_frames(hits.where("stream = 'temporal'").join(spans, "id"), ready).select("stream", "id", "score", "frame_index")
    of_frames = hits.where("stream = 'spatial'").select("stream", "id", "score", F.col("id").alias("frame_index"))
    best = of_frames.unionByName(of_clips).groupBy("frame_index").agg(F.max(r6("score")).alias("score"))
    return best.orderBy(F.desc("score"), "frame_index").limit(12)


@query
def g17_cache_miss(spark, sf_dir):
    """Requests without an unexpired result of the same key."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.concat_ws("|", F.col("item_id").cast("string"), F.col("text"), F.lit("10"), F.lit("true")).cast("binary")).alias("key"))
    results = b.where("item_id % 3 = 0").select("key", (F.col("item_id") * 600).alias("age_s"))
    return b.join(results.where("age_s < 3600").select("key"), "key", "left_anti").select("item_id", "key")


@query
def a11_medoid(spark, sf_dir):
    return cluster.medoids(frames(spark, sf_dir), "job_id").select("job_id", "medoid", "size")


@query
def g8_lloyd_fixed(spark, sf_dir):
    return cluster.lloyd(frames(spark, sf_dir), 4, 3).select("frame_index", F.col("cluster").cast("long").alias("cluster"))


@query
def x1_stream_shots(spark, sf_dir):
    h = histograms(spark, sf_dir).withColumn("at", F.timestamp_seconds((F.col("frame_index") + 19723) * 86400))
    path = _landed(h)
    stream = spark.readStream.schema(h.schema).parquet(path)
    return state.drained(state.stream_shots(stream, time="at"), _name("shots")).select("job_id", "frame_index", r6("distance").alias("distance"), r6("confidence").alias("confidence"))


@query
def x2_stream_limit(spark, sf_dir):
    r = requests(spark, sf_dir).select("identifier", "us")
    stream = spark.readStream.schema(r.schema).parquet(_landed(r))
    return state.drained(state.stream_limit(stream, 3, HOURS6), _name("limit"))


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


def _landed(df: DataFrame) -> str:
    """df as files that a stream can read, in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{_name('stream')}"
    df.write.parquet(path)
    return path

"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from shotlake.functions.media import FORMATS
from shotlake.operators.responses import SOURCE_CHARS

F = "f AS (SELECT CAST(label AS BIGINT) AS job_id, vec_id AS frame_index, vec_id * 500 AS timestamp_ms, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
O = f"{F}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_index) - 1 AS n, count(*) OVER (PARTITION BY job_id) AS total FROM f)"
H = (
    "h AS (SELECT user_id AS job_id, epoch_us(ts) // 86400000000 - 19723 AS frame_index, ["
    + ", ".join(f"count(*) FILTER (b = {k}) / (count(*) + 1e-7)" for k in range(8))
    + "] AS hist FROM (SELECT *, least(7, greatest(0, floor(value / 50))) AS b FROM events) GROUP BY ALL)"
)
DOT = "list_dot_product({0}, {1})"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    return f"{dot(a, b)} / ((sqrt({dot(a, a)}) + 1e-7) * (sqrt({dot(b, b)}) + 1e-7))"


def chi(a: str, b: str) -> str:
    return f"list_sum([({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) / ({a}[i] + {b}[i] + 1e-10) for i in range(1, 9)]) / 2"


def q(k: int = 0) -> str:
    return f"q AS (SELECT embedding AS e FROM f WHERE frame_index = {k})"


S0 = f"{F}, {q()}, s AS (SELECT job_id, frame_index, timestamp_ms, embedding, {cosine('embedding', 'e')} AS score FROM f, q)"
P0 = f"{F}, {q()}, s AS (SELECT job_id, frame_index, timestamp_ms, embedding, {dot('embedding', 'e')} AS score FROM f, q)"
E = "e AS (SELECT user_id AS identifier, epoch_us(ts) AS us, event_id, event_type, value FROM events)"
R = f"""{E}, r AS (SELECT identifier AS job_id, event_id AS seq, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'retry' ELSE
    CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'extracting' WHEN 'signup' THEN 'analyzing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'cancelled' END END AS requested FROM e)"""
A = "a AS (SELECT conv_id AS job_id, turn * 1000 AS timestamp_ms, turn AS seq, text AS answer, 1.0 / (turn + 1) AS relevance FROM conversations)"


def clips(mode: str) -> str:
    end = "start + 16" if mode == "seek" else "least(start + 15, total - 1)"
    keep = "WHERE least(16, total - start) >= 8" if mode == "seek" else ""
    return f"""c AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start) - 1 AS clip_index, start, least(16, total - start) AS length, {end} AS end_frame
    FROM (SELECT job_id, total, unnest(range(0, total, 8)) AS start FROM (SELECT job_id, count(*) AS total FROM f GROUP BY job_id)) {keep})"""


CLIPS = f"""{O}, {clips('seek')},
m AS (SELECT c.job_id, clip_index, start, length, o.n, timestamp_ms, embedding, CASE WHEN o.n = start + length - 1 THEN 17 - length ELSE 1 END AS w
      FROM c JOIN o ON o.job_id = c.job_id AND o.n BETWEEN start AND start + length - 1),
d AS (SELECT job_id, clip_index, w, unnest(embedding) AS x, unnest(range(0, 64)) AS pos FROM m),
p AS (SELECT job_id, clip_index, pos, sum(x * w) / 16 AS x FROM d GROUP BY ALL),
nn AS (SELECT job_id, clip_index, sqrt(sum(x * x)) + 1e-7 AS z FROM p GROUP BY ALL),
u AS (SELECT job_id, clip_index, pos, x / z AS x FROM p JOIN nn USING (job_id, clip_index)),
cv AS (SELECT job_id, clip_index, list(x ORDER BY pos) AS embedding FROM u GROUP BY ALL),
ct AS (SELECT job_id, clip_index, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM m GROUP BY ALL)"""


def lists(k_spatial: int, k_temporal: int, where: str = "true") -> str:
    c = "list_dot_product({0}, e) / ((sqrt(list_dot_product({0}, {0})) + 1e-7) * (sqrt(list_dot_product(e, e)) + 1e-7))"
    return f"""{q()}, sp AS (SELECT 'spatial' AS stream, frame_index AS id, 0.5 * {c.format('embedding')} AS score FROM f, q WHERE {where} ORDER BY score DESC, id LIMIT {k_spatial}),
te AS (SELECT 'temporal' AS stream, job_id * 1000 + clip_index AS id, 0.5 * {c.format('embedding')} AS score FROM cv, q WHERE {where} ORDER BY score DESC, id LIMIT {k_temporal})"""


HD = f"{H}, d AS (SELECT job_id, row_number() OVER w - 1 AS pos, frame_index, hist, lag(hist) OVER w AS prev FROM h WINDOW w AS (PARTITION BY job_id ORDER BY frame_index)), x AS (SELECT job_id, pos, frame_index, {chi('hist', 'prev')} AS distance FROM d WHERE prev IS NOT NULL)"
VD = f"{F}, d AS (SELECT job_id, row_number() OVER w - 1 AS pos, frame_index, embedding, lag(embedding) OVER w AS prev FROM f WINDOW w AS (PARTITION BY job_id ORDER BY frame_index)), x AS (SELECT job_id, pos, frame_index, 1 - {dot('embedding', 'prev')} AS distance FROM d WHERE prev IS NOT NULL)"


def threshold(configured: float) -> str:
    return f"greatest({configured}, avg(distance) OVER (PARTITION BY job_id) + 1.5 * stddev_pop(distance) OVER (PARTITION BY job_id))"


def greedy(source: str, key: str, x: str, gap: int, name: str = "kept", prefix: str = "g") -> str:
    """Recursive greedy filter of a relation: rows (all of its columns) that stay."""
    return f"""{prefix}n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {x}) AS rn FROM {source}),
{prefix}r AS (SELECT {key} AS k, rn, {x} AS last, true AS keep FROM {prefix}n WHERE rn = 1
  UNION ALL SELECT b.{key}, b.rn, CASE WHEN b.{x} - a.last >= {gap} THEN b.{x} ELSE a.last END, b.{x} - a.last >= {gap} FROM {prefix}r AS a JOIN {prefix}n AS b ON b.{key} = a.k AND b.rn = a.rn + 1),
{name} AS (SELECT n.* EXCLUDE (rn) FROM {prefix}n AS n JOIN {prefix}r AS r ON r.k = n.{key} AND r.rn = n.rn WHERE keep)"""


def shots(distances: str, configured: float, gap: int, adaptive: bool = True) -> str:
    t = threshold(configured) if adaptive else str(configured)
    return f"{distances}, y AS (SELECT *, {t} AS threshold FROM x), z AS (SELECT * FROM y WHERE distance > threshold), {greedy('z', 'job_id', 'pos', gap, 'b')}"


VS = shots(VD, 0.3, 3)
CAND = f"""{VS}, fw AS (SELECT job_id, frame_index, timestamp_ms, count(*) OVER (PARTITION BY job_id) AS total, min(frame_index) OVER (PARTITION BY job_id) AS lo, max(frame_index) OVER (PARTITION BY job_id) AS hi FROM f),
fe AS (SELECT fw.*, total >= 2 AND fw.frame_index IN (lo, hi) AS ends, b.pos IS NOT NULL AS isb FROM fw LEFT JOIN b ON b.job_id = fw.job_id AND b.frame_index = fw.frame_index),
fn AS (SELECT *, isb AND NOT ends AS inn, count(*) FILTER (isb AND NOT ends) OVER (PARTITION BY job_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS nth, CASE WHEN total >= 2 THEN 2 ELSE 0 END AS e2 FROM fe)"""


def candidates(target: int, most: int) -> str:
    return f"""{CAND}, ft AS (SELECT *, inn AND nth + e2 <= {most} AS taken FROM fn),
fl AS (SELECT *, least({target}, total) - e2 - count(*) FILTER (taken) OVER (PARTITION BY job_id) AS l FROM ft),
ca AS (SELECT job_id, frame_index, timestamp_ms, CASE WHEN ends THEN 0 ELSE 1 END AS source, l AS "left" FROM fl WHERE ends OR taken)"""


def diverse(source: str, want: str) -> str:
    """Max-min picks of a relation with job_id, frame_index, embedding, want."""
    unit = f"SELECT job_id, frame_index, {want} AS want, [x / (sqrt({dot('embedding', 'embedding')}) + 1e-7) for x in embedding] AS v, count(*) OVER (PARTITION BY job_id) AS total FROM {source}"
    return f"""du AS MATERIALIZED ({unit}),
dd AS MATERIALIZED (SELECT a.job_id, a.frame_index AS i, b.frame_index AS j, round(1 - {dot('a.v', 'b.v')}, 12) AS d FROM du AS a JOIN du AS b ON a.job_id = b.job_id AND a.total > a.want AND a.want > 0),
dm AS (SELECT job_id, i, round(avg(d), 12) AS m FROM dd GROUP BY ALL),
d0 AS (SELECT job_id, i, row_number() OVER (PARTITION BY job_id ORDER BY m DESC, i) AS r FROM dm),
dr AS (SELECT job_id, 0 AS step, i AS pick, [i] AS sel FROM d0 WHERE r = 1
  UNION ALL SELECT job_id, step + 1, j, list_append(sel, j) FROM (
    SELECT t.job_id, t.step, t.sel, c.j, row_number() OVER (PARTITION BY t.job_id ORDER BY min(c.d) DESC, c.j) AS r
    FROM dr AS t JOIN dd AS c ON c.job_id = t.job_id AND list_contains(t.sel, c.i) AND NOT list_contains(t.sel, c.j) JOIN (SELECT DISTINCT job_id, want FROM du) AS g ON g.job_id = t.job_id AND t.step + 1 < g.want
    GROUP BY t.job_id, t.step, t.sel, c.j) WHERE r = 1),
dv AS (SELECT job_id, pick AS frame_index, step AS pick FROM dr
  UNION ALL SELECT job_id, frame_index, row_number() OVER (PARTITION BY job_id ORDER BY frame_index) - 1 FROM du WHERE total <= want)"""


LABEL = "CASE WHEN {0} >= 3600000 THEN printf('%02d:', {0} // 3600000) ELSE '' END || printf('%02d:%02d.%03d', {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"
MMSS = "printf('%02d:%02d', {0} // 60000, {0} % 60000 // 1000)"
EXT = "lower(regexp_extract({0}, '[^/.][^/]*\\.([^./]*)$', 1))"


#: The legal transitions, written out.
LEGAL_PAIRS = {
    "pending": ["uploading", "processing", "cancelled"],
    "uploading": ["processing", "failed", "cancelled"],
    "processing": ["extracting", "failed", "cancelled"],
    "extracting": ["analyzing", "failed", "cancelled"],
    "analyzing": ["complete", "failed", "cancelled"],
    "failed": ["pending"],
}
LEGAL = "(" + " OR ".join(f"{{0}} = '{a}' AND {{1}} IN ({', '.join(repr(b) for b in bs)})" for a, bs in LEGAL_PAIRS.items()) + ")"
FOLD = f"""{R}, fr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM r),
st AS (SELECT DISTINCT job_id, 0 AS rn, 'pending' AS status, 0 AS retries, 0 AS rejected FROM fr
  UNION ALL SELECT job_id, rn, CASE WHEN re THEN 'pending' WHEN ok THEN requested ELSE status END, retries + CAST(re AS INT), rejected + CAST(NOT (re OR ok) AS INT) FROM (
    SELECT t.job_id, f.rn, t.status, t.retries, t.rejected, f.requested, f.requested = 'retry' AND t.status = 'failed' AND t.retries < 3 AS re,
      (f.requested = 'failed' AND t.status NOT IN ('complete', 'cancelled')) OR (f.requested = 'cancelled' AND t.status NOT IN ('complete', 'failed', 'cancelled'))
      OR (f.requested NOT IN ('failed', 'cancelled', 'retry', 'pending') AND {LEGAL.format('t.status', 'f.requested')}) AS ok
    FROM st AS t JOIN fr AS f ON f.job_id = t.job_id AND f.rn = t.rn + 1)),
fin AS (SELECT job_id, arg_max(status, rn) AS status, CAST(arg_max(retries, rn) AS BIGINT) AS retries, CAST(arg_max(rejected, rn) AS BIGINT) AS rejected FROM st GROUP BY job_id)"""
AGG = "SELECT job_id, {0} AS answer, round(avg(relevance), 6) AS confidence, count(*) AS n FROM {1} GROUP BY job_id"
AN = f"{A}, an AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY timestamp_ms, seq) AS rn, count(*) OVER (PARTITION BY job_id) AS total FROM a)"
WIN = 6 * 3600 * 1_000_000


def lloyd(k: int, steps: int) -> str:
    out = f"{F}, c0 AS (SELECT row_number() OVER (ORDER BY frame_index) - 1 AS cluster, embedding AS centre FROM f ORDER BY frame_index LIMIT {k})"
    for s in range(steps + 1):
        out += f""", n{s} AS (SELECT frame_index, embedding, cluster, row_number() OVER (PARTITION BY frame_index ORDER BY round(list_sum([(embedding[i] - centre[i]) * (embedding[i] - centre[i]) for i in range(1, 65)]), 9), cluster) AS r FROM f, c{s}),
a{s} AS (SELECT * FROM n{s} WHERE r = 1)"""
        if s < steps:
            out += f""", e{s} AS (SELECT cluster, unnest(embedding) AS x, unnest(range(0, 64)) AS pos FROM a{s}), m{s} AS (SELECT cluster, pos, avg(x) AS x FROM e{s} GROUP BY ALL), c{s + 1} AS (SELECT cluster, list(x ORDER BY pos) AS centre FROM m{s} GROUP BY cluster)"""
    return f"WITH {out} SELECT frame_index, cluster FROM a{steps}"


CHUNKED = "job_id, clip_index, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(end_frame AS BIGINT) AS end_frame"
ORACLES = {
    "v1_cosine": f"WITH {S0} SELECT frame_index, round(score, 6) AS score FROM s",
    "v2_normalise_norms": f"WITH {F}, g AS (SELECT frame_index, 2 * sqrt({dot('embedding', 'embedding')}) AS n FROM f) SELECT frame_index, round(n, 6) AS norm, round(n / (n + 1e-7), 6) AS unit_norm FROM g",
    "v3_dot": f"WITH {F}, {q(1)} SELECT frame_index, round({dot('embedding', 'e')}, 6) AS score FROM f, q",
    "v4_chi2_pairs": f"WITH {H} SELECT a.job_id, a.frame_index AS a, b.frame_index AS b, round({chi('a.hist', 'b.hist')}, 6) AS distance FROM h AS a JOIN h AS b ON a.job_id = b.job_id AND a.frame_index < b.frame_index",
    "v5_histogram": f"WITH {H} SELECT job_id, frame_index, unnest(range(0, 8)) AS bin, unnest([round(x, 6) for x in hist]) AS share FROM h",
    "v5_channel_bins": "SELECT CAST(floor(value * 64 / 256) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 256 GROUP BY 1",
    "v6_fingerprint": f"""WITH {F}, g AS (SELECT frame_index, [CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR) for x in embedding] AS t FROM f)
SELECT frame_index, substr(md5(len(t) || ',' || array_to_string(t[1:4], ',') || ',' || array_to_string(t[-4:], ',')), 1, 16) AS fingerprint, md5(array_to_string(t, ',')) AS full FROM g""",
    "v7_json_roundtrip": f"WITH {F} SELECT frame_index, len(embedding) AS n, CAST(to_json(embedding) AS DOUBLE[]) = embedding AS same FROM f",
    "v8_minmax": f"WITH {S0} SELECT frame_index, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-7), 6) AS scaled FROM s WINDOW w AS (PARTITION BY job_id)",
    "v9_distance": f"WITH {S0} SELECT frame_index, round(1 - score, 6) AS distance FROM s",
    "o2_topk": f"WITH {S0} SELECT frame_index, round(score, 6) AS score FROM s ORDER BY s.score DESC, frame_index LIMIT 10",
    "o4_rank_all": f"WITH {F}, {q(3)}, s AS (SELECT job_id, frame_index, {dot('embedding', 'e')} AS sc FROM f, q) SELECT job_id, frame_index, row_number() OVER (PARTITION BY job_id ORDER BY sc DESC, frame_index) AS rank, round(sc, 6) AS score FROM s",
    "o8_multi_topk": f"""WITH {F}, s AS (SELECT a.frame_index AS query_id, b.frame_index, {cosine('b.embedding', 'a.embedding')} AS sc FROM f AS a JOIN f AS b ON a.frame_index % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, frame_index) AS rank FROM s) SELECT query_id, frame_index, rank, round(sc, 6) AS score FROM t WHERE rank <= 5""",
    "j6_pairs_in_label": f"WITH {F} SELECT a.job_id, a.frame_index AS a, b.frame_index AS b, round({cosine('a.embedding', 'b.embedding')}, 6) AS score FROM f AS a JOIN f AS b ON a.job_id = b.job_id AND a.frame_index < b.frame_index",
    "u1_fused": f"WITH {CLIPS}, {lists(10, 10)} SELECT stream, id, round(score, 6) AS score FROM (FROM sp UNION ALL FROM te)",
    "u1_fused_no_temporal": f"WITH {CLIPS}, {lists(10, 10)} SELECT stream, id, round(score, 6) AS score FROM sp",
    "j11_clip_to_frames": f"WITH {CLIPS} SELECT ct.job_id, clip_index, f.frame_index FROM ct JOIN f ON f.job_id = ct.job_id AND f.timestamp_ms BETWEEN start_ms AND end_ms",
    "w2_clips_seek": f"WITH {F}, {clips('seek')} SELECT {CHUNKED} FROM c WHERE clip_index < 500",
    "w3_clips_batch": f"WITH {F}, {clips('batch')} SELECT {CHUNKED} FROM c WHERE clip_index < 500",
    "a13_clip_pool": f"WITH {CLIPS} SELECT job_id, clip_index, pos, round(x, 6) AS x FROM u",
    "s1_stride_sample": f"""WITH {E}, o AS (SELECT identifier AS job_id, event_id AS frame_index, row_number() OVER (PARTITION BY identifier ORDER BY event_id) - 1 AS n FROM e),
k AS (SELECT *, CASE WHEN job_id % 5 = 0 THEN 30.0 ELSE 7.0 END AS fps FROM o), t AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n) AS r FROM k WHERE n % greatest(1, CAST(floor(fps / 2.0) AS BIGINT)) = 0)
SELECT job_id, n, frame_index, CAST(trunc(CAST(n AS DOUBLE) / CAST(fps AS DOUBLE) * 1000) AS BIGINT) AS timestamp_ms FROM t WHERE r <= 15""",
    "s3_seek_by_ms": f"""WITH {E}, o AS (SELECT identifier AS job_id, event_id AS frame_index, row_number() OVER (PARTITION BY identifier ORDER BY event_id) - 1 AS n FROM e),
t AS (SELECT unnest([0, 467, 1000, 5000, 900000]) AS ms) SELECT job_id, CAST(ms AS BIGINT) AS ms, n, frame_index FROM o JOIN t ON n = CAST(trunc(ms / 1000 * CAST(29.97 AS DOUBLE)) AS BIGINT)""",
    "o5_frame_cap": f"WITH {E}, t AS (SELECT identifier AS job_id, event_id AS frame_index, row_number() OVER (PARTITION BY identifier ORDER BY event_id) AS rank FROM e) SELECT * FROM t WHERE rank <= 10",
    "s8_probe": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 0 ELSE CAST(trunc(length(html) / (24.0 + page_id % 7)::DOUBLE * 1000) AS BIGINT) END AS duration_ms, chr(828601953 & 255) || chr((828601953 >> 8) & 255) || chr((828601953 >> 16) & 255) || chr((828601953 >> 24) & 255) AS codec FROM pages",
    "t1_timestamp_label": f"SELECT event_id, {LABEL.format('(event_id * 977)')} AS label FROM events",
    "t2_mmss": f"SELECT event_id, {MMSS.format('(event_id * 977)')} AS label FROM events",
    "t3_extension": "SELECT page_id, " + EXT.format("regexp_replace(url, '[?#].*$', '')") + " AS extension FROM pages",
    "t5_path_clean": "SELECT page_id, replace(regexp_replace('//../' || regexp_replace(url, '^[a-z]+:/', '') || '/../x', '^/+', ''), '..', '') AS path FROM pages",
    "t6_url_parts": """SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), ''), 'localhost') AS host, CASE WHEN page_id % 2 = 0 THEN 6380 ELSE 6379 END AS port, CASE WHEN page_id % 3 = 0 THEN 4 ELSE 0 END AS db FROM pages""",
    "t7_keys": "SELECT 'job:' || conv_id || ':temporal:' || turn AS key, conv_id AS job_id, turn AS n FROM conversations",
    "t8_round_trip": "SELECT event_id, CAST(trunc(event_id / 30.0::DOUBLE * 1000) AS BIGINT) AS ms, CAST(trunc(CAST(trunc(event_id / 30.0::DOUBLE * 1000) AS BIGINT) / 1000 * 30.0::DOUBLE) AS BIGINT) AS back FROM events",
    "t12_expired": "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31'",
    "t13_data_url": "SELECT item_id, 'data:image/jpeg;base64,' || base64(encode(text)) AS url FROM benchmark",
    "k12_frame_path": "SELECT vec_id AS frame_index, printf('frame_%06d.jpg', vec_id) AS path FROM embeddings",
    "p1_validate": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN lower(['mp4', 'MKV', 'txt', 'webm', ''][doc_id % 5 + 1]) NOT IN {FORMATS} THEN 'format' WHEN n_chars * 100000 > 524288000 THEN 'size' END AS r FROM documents)
SELECT doc_id, r IS NULL AS valid, coalesce(r, '-') AS reason FROM t""",
    "p4_needs_preprocess": "SELECT doc_id, doc_id % 3 = 1 OR n_chars > 1920 OR n_chars % 2000 > 1080 AS needs FROM documents",
    "p5_constraints": "SELECT doc_id, length(text) BETWEEN 1 AND 2000 AND doc_id % 60 BETWEEN 1 AND 50 AS ok FROM documents",
    "p7_terminal": f"WITH {R} SELECT requested, count(*) AS n FROM r WHERE requested IN ('complete', 'failed', 'cancelled') GROUP BY 1",
    "w1_hist_distance": f"WITH {HD} SELECT job_id, pos, frame_index, round(distance, 6) AS distance FROM x",
    "a1_threshold": f"WITH {HD} SELECT job_id, round(greatest(0.3, avg(distance) + 1.5 * stddev_pop(distance)), 6) AS threshold FROM x GROUP BY job_id",
    "g1_shots": f"WITH RECURSIVE {shots(HD, 0.1, 3)} SELECT job_id, pos, frame_index, round(least(1.0, distance / (3 * threshold)), 6) AS confidence FROM b",
    "g1_shots_fixed": f"WITH RECURSIVE {shots(HD, 0.3, 1, False)} SELECT job_id, pos, frame_index, round(least(1.0, distance / (3 * threshold)), 6) AS confidence FROM b",
    "g2_gap_filter": f"WITH RECURSIVE {E}, {greedy('e', 'identifier', 'us', WIN // 6)} SELECT identifier, us, event_id FROM kept",
    "w4_temporal_score": f"WITH {F}, p AS (SELECT frame_index, timestamp_ms / (max(timestamp_ms) OVER w - min(timestamp_ms) OVER w + 1) AS z FROM f WINDOW w AS (PARTITION BY job_id)) SELECT frame_index, round(z, 6) AS position, round(1 - 0.5 * abs(z - 0.5), 6) AS temporal_score FROM p",
    "g5_score": f"""WITH RECURSIVE {VS}, {q()}, s AS (SELECT job_id, frame_index, timestamp_ms / (max(timestamp_ms) OVER w - min(timestamp_ms) OVER w + 1) AS z, {dot('embedding', 'e')} AS sc FROM f, q WINDOW w AS (PARTITION BY job_id)),
t AS (SELECT *, (sc - min(sc) OVER w) / (max(sc) OVER w - min(sc) OVER w + 1e-7) AS qn FROM s WINDOW w AS (PARTITION BY job_id))
SELECT t.job_id, t.frame_index, round(0.3 * (1 - 0.5 * abs(z - 0.5)) + CASE WHEN b.pos IS NULL THEN 0 ELSE 0.3 END + 0.2 * qn, 6) AS score FROM t LEFT JOIN b ON b.job_id = t.job_id AND b.frame_index = t.frame_index""",
    "g4_diverse": f"WITH RECURSIVE {F}, {diverse('f', '6')} SELECT job_id, frame_index, CAST(pick AS BIGINT) AS pick FROM dv",
    "u2_candidates": f'WITH RECURSIVE {candidates(15, 5)} SELECT job_id, frame_index, CAST(source AS BIGINT) AS source, "left" FROM ca',
    "g6_select": f"""WITH RECURSIVE {candidates(8, 30)}, lw AS (SELECT job_id, any_value("left") AS l FROM ca GROUP BY job_id),
re AS (SELECT f.*, l FROM f JOIN lw USING (job_id) ANTI JOIN ca ON ca.job_id = f.job_id AND ca.frame_index = f.frame_index),
rp AS (SELECT * FROM re WHERE l > 0), {diverse('rp', 'l')},
un AS (SELECT DISTINCT job_id, frame_index FROM (SELECT job_id, frame_index FROM ca UNION ALL SELECT job_id, frame_index FROM dv)),
ut AS (SELECT job_id, frame_index, timestamp_ms FROM un JOIN f USING (job_id, frame_index)), {greedy('ut', 'job_id', 'timestamp_ms', 2000, 'kept', 'k')}
SELECT job_id, frame_index, timestamp_ms FROM kept""",
    "w5_rate_limit": f"""WITH {E}, d AS (SELECT DISTINCT identifier, us FROM e), t AS (SELECT *, count(*) OVER (PARTITION BY identifier ORDER BY us RANGE BETWEEN {WIN - 1} PRECEDING AND CURRENT ROW) AS n FROM d)
SELECT identifier, us, n, n <= 3 AS allowed, greatest(0, 3 - n) AS remaining, (us + {WIN}) // 1000000 AS reset_s FROM t""",
    "w6_rate_info": f"WITH {E}, d AS (SELECT DISTINCT identifier, us FROM e), t AS (SELECT *, count(*) OVER (PARTITION BY identifier ORDER BY us RANGE BETWEEN {WIN} PRECEDING AND CURRENT ROW) AS n FROM d) SELECT identifier, us, n, greatest(0, 3 - n) AS remaining FROM t",
    "j9_transitions": f"WITH {R}, t AS (SELECT job_id, seq, requested, coalesce(lag(requested) OVER (PARTITION BY job_id ORDER BY seq), 'pending') AS before FROM r) SELECT job_id, seq, {LEGAL.format('before', 'requested')} AS legal FROM t",
    "g11_state_fold": f"WITH RECURSIVE {FOLD} SELECT job_id, status, retries, rejected FROM fin",
    "g12_progress": f"WITH RECURSIVE {FOLD} SELECT job_id, status, CASE WHEN status IN ('pending', 'uploading') THEN 'upload' WHEN status = 'processing' THEN 'preprocess' WHEN status = 'extracting' THEN 'extract' WHEN status = 'analyzing' THEN 'analyze' WHEN status = 'complete' THEN 'complete' ELSE 'failed' END AS stage, CAST(CASE status WHEN 'processing' THEN 0.1 WHEN 'extracting' THEN 0.3 WHEN 'analyzing' THEN 0.7 WHEN 'complete' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS progress, status IN ('complete', 'failed', 'cancelled') AS done FROM fin",
    "w9_retries": f"WITH {R}, t AS (SELECT job_id, seq, count(*) FILTER (requested = 'failed') OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS attempt FROM r) SELECT job_id, seq, attempt, attempt < 3 AS may_retry FROM t",
    "k2_upsert": "SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'good' ELSE source END AS source, n_chars FROM documents LEFT JOIN labels USING (doc_id)",
    "k4_path_update": f"WITH {F} SELECT job_id, frame_index, frame_index % 4 = 0 AS is_selected, CASE WHEN frame_index % 4 = 0 THEN printf('frame_%06d.jpg', frame_index) END AS frame_path FROM f",
    "k9_delete": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "d4_dedupe": "WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS l_linenumber, arg_max(l_partkey, l_linenumber) AS l_partkey FROM l GROUP BY l_orderkey",
    "a6_counts": f"""WITH RECURSIVE {VS}, {clips('seek')}, nf AS (SELECT job_id, count(*) AS n_frames FROM f GROUP BY 1), nc AS (SELECT job_id, count(*) AS n_clips FROM c GROUP BY 1), ns AS (SELECT job_id, count(*) AS n_shots FROM b GROUP BY 1)
SELECT job_id, n_frames, coalesce(n_clips, 0) AS n_clips, coalesce(n_shots, 0) AS n_shots FROM nf LEFT JOIN nc USING (job_id) LEFT JOIN ns USING (job_id)""",
    "g9_list": f"WITH {AN} " + AGG.format(f"string_agg('[' || {MMSS.format('timestamp_ms')} || '] ' || answer, chr(10) ORDER BY rn)", "an"),
    "g9_synthesize": f"WITH {AN} " + AGG.format("string_agg(CASE WHEN total = 1 THEN '' WHEN rn = 1 THEN 'At the beginning (' || " + MMSS.format("timestamp_ms") + " || '): ' WHEN rn = total THEN 'Finally (' || " + MMSS.format("timestamp_ms") + " || '): ' ELSE 'At ' || " + MMSS.format("timestamp_ms") + " || ': ' END || answer, ' ' ORDER BY rn)", "an"),
    "g9_concat": f"WITH {AN} " + AGG.format("string_agg(answer, ' ' ORDER BY rn)", "an"),
    "a10_equal_weight": f"WITH {A} SELECT job_id, seq, round(1.0 / count(*) OVER (PARTITION BY job_id), 6) AS weight, substr(answer, 1, {SOURCE_CHARS}) AS description FROM a",
    "g13_analysis": f"WITH {AN} SELECT job_id, 'Question: What happens?' || chr(10) || 'Frames:' || chr(10) || string_agg('Frame ' || rn || ' at ' || {LABEL.format('timestamp_ms')}, chr(10) ORDER BY rn) AS prompt FROM an GROUP BY job_id",
    "g13_summary": f"WITH {AN} SELECT job_id, 'Summarise these observations:' || chr(10) || string_agg(rn || '. [' || {LABEL.format('timestamp_ms')} || '] ' || answer, chr(10) ORDER BY rn) AS prompt FROM an GROUP BY job_id",
    "g13_comparison": f"WITH {AN} SELECT job_id, 'Compare with regard to: mood' || chr(10) || string_agg('Item ' || rn || ': ' || answer, chr(10) ORDER BY rn) AS prompt FROM an GROUP BY job_id",
    "g14_query_path": f"""WITH RECURSIVE {FOLD}, {CLIPS}, {lists(8, 4, "job_id IN (SELECT job_id FROM fin WHERE status = 'complete')")}, hits AS (FROM sp UNION ALL FROM te),
fo AS (SELECT id AS frame_index, score FROM hits WHERE stream = 'spatial' UNION ALL
  SELECT f.frame_index, score FROM hits JOIN ct ON ct.job_id * 1000 + ct.clip_index = id JOIN f ON f.job_id = ct.job_id AND timestamp_ms BETWEEN start_ms AND end_ms WHERE stream = 'temporal')
SELECT frame_index, max(round(score, 6)) AS score FROM fo GROUP BY frame_index ORDER BY score DESC, frame_index LIMIT 12""",
    "g17_cache_miss": "SELECT item_id, md5(item_id || '|' || text || '|10|true') AS key FROM benchmark WHERE NOT (item_id % 3 = 0 AND item_id * 600 < 3600)",
    "a11_medoid": f"""WITH {F}, e AS (SELECT job_id, unnest(embedding) AS x, unnest(range(0, 64)) AS pos FROM f), m AS (SELECT job_id, pos, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT job_id, list(x ORDER BY pos) AS centre FROM m GROUP BY job_id),
d AS (SELECT job_id, frame_index, round(list_sum([(embedding[i] - centre[i]) * (embedding[i] - centre[i]) for i in range(1, 65)]), 9) AS d FROM f JOIN c USING (job_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY d, frame_index) AS rn, count(*) OVER (PARTITION BY job_id) AS size FROM d) SELECT job_id, frame_index AS medoid, size FROM r WHERE rn = 1""",
    "g8_lloyd_fixed": lloyd(4, 3),
    "x1_stream_shots": f"WITH {HD} SELECT job_id, frame_index, round(distance, 6) AS distance, round(least(1.0, distance / 0.9), 6) AS confidence FROM x WHERE distance > 0.3",
    "x2_stream_limit": f"WITH {E}, d AS (SELECT DISTINCT identifier, us FROM e), t AS (SELECT *, count(*) OVER (PARTITION BY identifier ORDER BY us RANGE BETWEEN {WIN - 1} PRECEDING AND CURRENT ROW) AS n FROM d) SELECT identifier, us, n, n <= 3 AS allowed FROM t",
}
ORACLES["g7_frame_rows"] = (
    ORACLES["g6_select"].replace("SELECT job_id, frame_index, timestamp_ms FROM kept", "")
    + "SELECT k.job_id, k.frame_index, k.timestamp_ms, CASE WHEN b.pos IS NULL THEN 'regular' ELSE 'scene_boundary' END AS frame_type FROM kept AS k LEFT JOIN b ON b.job_id = k.job_id AND b.frame_index = k.frame_index"
)

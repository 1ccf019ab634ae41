"""The registered queries of this subpackage: thin functions of (spark, folder of the tables) over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, passages, pii, quality, secrets, sharding, suffixes, warc
from .shared import hex_sha256
from .spans import joined


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand inside a benchmark window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.verdicts(decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))).drop("tag")


def op2_sentencepiece_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return back.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 50-byte strings of smaller documents."""
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("row.doc_id", *counts, hex_sha256(joined(F.col("base"))).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the cascade on every document, and its metrics: those that the cascade did not come to are filled in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.filled(quality.cascade(quality.prepared(docs), quality.ordered(quality.sampled(docs))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept")
    )


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("row.doc_id", *counts, hex_sha256(joined(F.col("base"))).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op9_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of fifty words or more that an earlier document has too, exactly or nearly."""
    return passages.find(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_prefix_filter_decontamination": op1_prefix_filter_decontamination,
    "op2_sentencepiece_byte_bpe": op2_sentencepiece_byte_bpe,
    "op3_suffix_radix_dedup": op3_suffix_radix_dedup,
    "op4_lsh_forest_join": op4_lsh_forest_join,
    "op5_weak_supervision_pii": op5_weak_supervision_pii,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_rule_cascade": op7_rule_cascade,
    "op8_markov_secrets": op8_markov_secrets,
    "op9_sharded_warc": op9_sharded_warc,
    "op10_collinear_passages": op10_collinear_passages,
}

#: DuckDB text of what SQL can express.
ORACLES = {
    "op9_sharded_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 1000""",
    "op1_prefix_filter_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(g) AS n, g FROM (SELECT item_id, list_slice(w, i, i + 12) AS g FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win USING (g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_rule_cascade": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT n_symbols > n_words AND NOT 100 * n_dup_lines > 50 * n_lines
       AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 25 AS kept
FROM f""",
}

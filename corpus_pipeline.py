"""Corpus preparation in five stages over ``documents``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm import bpe, decontaminate, jaccard, quality, secrets
from shotlake.llm.shared import clean, fresh_path, mark, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade of rules rejects go."""
    return quality.apply_rules(docs).where("rejected_by IS NULL").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts, and the rest of a token that one is part of, are replaced by their kind; n_chars follows."""
    found = secrets.scan(docs)
    text = F.when(F.col("row.text").isNotNull(), secrets.redacted(F.col("text"), secrets.extended(F.col("found"), F.col("touched"))))
    out = found.select("row.*", text.alias("_text"), (F.size("found") > 0).alias("_changed"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_changed"), F.char_length("_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, packed ids of every text, their number, and digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).select(
        "doc_id", "lang", "source", "ids", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can express neither the character models nor BPE; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = mark()
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), name, path)
        clean(spark, begun, path)  # the stage before and what this one left
    return STAGES[-1][1](spark, docs, sf_dir)

"""Benchmark decontamination by a prefix-filtered set join (native).

A window is 13 consecutive words of a benchmark item (a shorter item is one window). A window occurs in a document only
if all its shingles (three words) do, so the necessary prefix under an order by rarity is its one rarest shingle. The
shingles of the benchmark are counted over the whole corpus, each window is filed under its rarest shingle, and the
documents' shingles are joined with those prefix tokens alone. The position of the match places the window in the
document; windows that would start before the first or end behind the last word are dropped (positional and length
bounds), and the rest are compared word by word.

A window of fewer words than a shingle is filed under all of its words; only windows so short make single words and pairs of
words probes. The benchmark is broadcast if its windows have at most ``BROADCAST_BYTES`` of text; above that its side is
shuffled, the shingles of documents are first thinned out by a bitmap of bounded size, and document words are fetched for
candidates by a second join.

Defined results: a null text has no words; an item without words or without an id has no window; repeated items each count under their
item_id (equal ids once); repeated document rows each give a row; empty tables give an empty result or no hits; further
columns are not carried by ``hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import bits, maybe_in
from .shared import hex_sha256, text_or_empty, written

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 13, 3
#: Most bytes of the words of all windows of a benchmark that is broadcast.
BROADCAST_BYTES = 20_000_000

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A to Z only) runs of digits, letters and whatever is not ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _NOT_WORD, -1), "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of all k consecutive words."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words of each distinct window."""
    items = benchmark.where(F.col(id).isNotNull()).select(F.col(id).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(WINDOW)))).alias("words")).distinct()


def _tokens(docs: DataFrame, ks: list[int]) -> DataFrame:
    """doc_id, th (hash of the text), words, and a row per shingle of ks words: first (whether it is the row's first), pos,
    h. A document without any has one row, pos null."""
    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), words_of(F.col("text")).alias("words"))
    if len(ks) == 1:
        rows = d.select("*", F.posexplode_outer(shingles(F.col("words"), ks[0])).alias("pos", "h"))
        return rows.withColumn("first", F.coalesce(F.col("pos") == 0, F.lit(True)))
    each = F.concat(*[F.transform(shingles(F.col("words"), k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in ks])
    rows = d.select("*", F.posexplode_outer(each).alias("n", "x"))
    return rows.select("doc_id", "th", "words", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"), F.coalesce(F.col("n") == 0, F.lit(True)).alias("first"))


def prefix_tokens(docs: DataFrame, wins: DataFrame, ks: list[int], small: bool) -> DataFrame:
    """h, and the windows filed under it: array of (item_id, offset of the shingle, words)."""
    k = F.least(F.size("words"), F.lit(SHINGLE))
    own = None
    for n in ks:
        part = wins.where(k == n).select("item_id", "words", F.posexplode(shingles(F.col("words"), n)).alias("offset", "h"))
        own = part if own is None else own.unionByName(part)
    wanted = written(own.select("h").distinct(), "wanted-shingles")
    seen = _tokens(docs, ks).select("h").where("h IS NOT NULL")
    if small:
        seen = seen.join(F.broadcast(wanted), "h", "left_semi")
    else:
        seen = maybe_in(seen, F.col("h"), bits(wanted, F.col("h"))).join(wanted, "h")
    counts = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rare = own.join(counts, "h")  # a window with a shingle that the corpus lacks cannot occur
    first = rare.groupBy("item_id", "words").agg(F.min(F.struct("n", "h", "offset")).alias("m"), F.count(F.lit(1)).alias("found"))
    whole = first.where(F.col("found") == F.size("words") - (k - 1))
    return whole.groupBy(F.col("m.h").alias("h")).agg(F.collect_list(F.struct("item_id", F.col("m.offset").alias("offset"), "words")).alias("wins"))


def hits(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, tag (hash of the text), n_words, hits: array of (item_id, start, len) of the windows that occur."""
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    wins = written(windows(benchmark), "windows")
    size, ks = wins.agg(F.sum(F.octet_length(F.array_join("words", " ")).cast("long")), F.collect_set(F.least(F.size("words"), F.lit(SHINGLE)))).first()
    small, ks = (size or 0) <= broadcast_bytes, sorted(ks or [SHINGLE], reverse=True)  # as many as SHINGLE at most
    tokens = written(prefix_tokens(docs, wins, ks, small), "prefix-tokens")
    rows = _tokens(docs, ks)
    n_words, pos = F.size("words"), F.col("pos")

    def occurs(w: Column) -> Column:
        start = pos - w["offset"]
        inside = (start >= 0) & (start + F.size(w["words"]) <= n_words)
        return inside & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size(w["words"])) == w["words"])

    found = F.transform(F.filter("wins", occurs), lambda w: F.struct(w["item_id"].alias("item_id"), (pos - w["offset"]).alias("start"), F.size(w["words"]).alias("len")))
    none = F.array().cast(found_type(benchmark))
    if small:
        # every document keeps the row of its first shingle; of the others only matches go on
        got = rows.join(F.broadcast(tokens), "h", "left").where(F.col("wins").isNotNull() | F.col("first"))
        got = got.select("doc_id", "th", n_words.alias("n_words"), F.col("first").cast("int").alias("first"), F.coalesce(F.when(F.col("wins").isNotNull(), found), none).alias("f"))
    else:
        near = maybe_in(rows.select("doc_id", "th", "pos", "h").where("h IS NOT NULL"), F.col("h"), bits(tokens, F.col("h")))
        # the windows of a token are joined where they are needed: a match carries its token only
        hit = near.join(tokens.select("h"), "h").groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "h")).alias("c"))
        d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), words_of(F.col("text")).alias("words"))
        same = d["doc_id"].eqNullSafe(hit["doc_id"]) & (d["th"] == hit["th"])
        got = d.join(hit, same).select(d["doc_id"], d["th"], "words", F.explode("c").alias("c"))
        got = got.select("doc_id", "th", "words", F.col("c.pos").alias("pos"), F.col("c.h").alias("h")).join(tokens, "h")
        got = got.select("doc_id", "th", n_words.alias("n_words"), F.lit(0).alias("first"), found.alias("f"))
        got = got.unionByName(d.select("doc_id", "th", F.size("words").alias("n_words"), F.lit(1).alias("first"), none.alias("f")))
    by_doc = got.groupBy("doc_id", "th").agg(F.max("n_words").cast("long").alias("n_words"), F.sum("first").cast("int").alias("copies"), F.flatten(F.collect_set("f")).alias("hits"))
    return by_doc.select("doc_id", F.col("th").alias("tag"), "n_words", F.array_distinct("hits").alias("hits"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")


def found_type(benchmark: DataFrame, id: str = "item_id") -> str:
    return f"array<struct<item_id:{benchmark.schema[id].dataType.simpleString()},start:int,len:int>>"


def n_hit(hits: Column) -> Column:
    """Words inside any of the hits."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["len"]).alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.greatest(s["end"] - F.greatest(a["at"], s["start"]), F.lit(0))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), (a["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def verdicts(found: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, n_hit, n_items, items_sha256, contaminated from hits()."""
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    out = found.select("doc_id", "tag", "n_words", n_hit(F.col("hits")).alias("n_hit"), items.alias("items"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "tag", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), hex_sha256(F.array_join("items", ",")).alias("items_sha256"), contaminated.alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    bad = verdicts(hits(docs, benchmark, id, text)).where("contaminated").select(F.col("doc_id").alias("i"), F.col("tag").alias("t")).distinct()
    held = docs.select(F.struct("*").alias("row"), F.col(id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("tag"))
    return held.join(bad, held["doc_id"].eqNullSafe(bad["i"]) & (held["tag"] == bad["t"]), "left_anti").select("row.*")

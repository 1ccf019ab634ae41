"""Byte-balanced sharding by histogram sort (native).

Rows are ordered by a two-part key: a hash of the text, then the id. So equal texts are neighbours. Splitters are found
by rounds: each round lays probes into every interval that still holds a wanted splitter, counts the exact bytes between
them over all partitions (one small aggregate, at most ranges x probes rows), and keeps the interval between the two
probes that enclose the wanted total. A splitter is settled once the bytes below its lower end are within the
tolerance of the wanted total, or its interval holds one key. Only when one hash value alone is too heavy (a large group
of equal texts) does the search go on over ids inside it, so a group is cut only where the tolerance demands it.
Then rows are exchanged once, by range; a shard is a number of ranges that grows with the rows, up to MAX_RANGES in all, so
no task holds a whole shard and the driver never more than MAX_RANGES * 2**DIGIT counts.

Defined results: a null text counts as empty; a null id sorts first; rows equal in text and id stay in one shard and get
different slots; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, written

#: Share of a shard by which a splitter may miss its wanted total before ids are searched too.
TOLERANCE = 0.005
#: Bits by which a round refines the probes of an open interval, and of the first round.
DIGIT, FIRST_DIGIT = 6, 12
#: Least ranges that make a shard, rows beyond which there are more, and most ranges of all shards. Each is one task's work.
RANGES_PER_SHARD, ROWS_PER_RANGE, MAX_RANGES = 8, 1_000_000, 4096

_LOW, _HIGH = -(2**63), 2**63


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), size (UTF-8 bytes plus 1), text_crc32."""
    t = text_or_empty(text)
    return docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.xxhash64(t).alias("h"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )


def _search(keys: DataFrame, wanted: Sequence[tuple[int, int]], below: dict[int, int], tolerance: float, first: int) -> list[tuple[int, int, int]]:
    """keys: part, key, size. wanted: (part, total) of each splitter; below: bytes before each part. Returns for each
    splitter (cut, bytes below it, rows of the one key at the cut if that key straddles the total, else 0).

    Probes stand at multiples of 2**shift. A round reads the bytes of every bucket between them, of the buckets that
    still hold an unsettled splitter, and divides those by 2**DIGIT in the next round; first is the first round's shift."""
    cut, under, heavy = [0] * len(wanted), [below[p] for p, _ in wanted], [0] * len(wanted)
    bucket: list[int | None] = [None] * len(wanted)
    open_, shift, last = set(range(len(wanted))), first, first
    while open_:
        rows = keys.withColumn("k", F.shiftright("key", shift))
        if last != shift:
            rows = rows.where(F.shiftright("key", last).isin(sorted({bucket[i] for i in open_})))
        got: dict[tuple, list] = {}
        for r in rows.groupBy("part", "k").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
            got.setdefault((r["part"], None if last == shift else r["k"] >> (last - shift)), []).append(r)
        for x in got.values():
            x.sort(key=lambda r: r["k"])
        for i in sorted(open_):
            part, total = wanted[i]
            here = got[part, bucket[i]]
            for r in here:
                if under[i] + r["b"] > total or r is here[-1]:
                    break
                under[i] += r["b"]
            bucket[i], left, right = r["k"], total - under[i], under[i] + r["b"] - total
            if min(left, right) <= tolerance or r["lo"] == r["hi"]:
                open_.discard(i)
                cut[i] = r["lo"]
                if min(left, right) > tolerance and r["n"] > 1:
                    heavy[i] = r["n"]
                elif right < left:
                    cut[i], under[i] = r["hi"] + 1, under[i] + r["b"]
        last, shift = shift, max(0, shift - DIGIT)
    return list(zip(cut, under, heavy, strict=True))


def splitters(keys: DataFrame, n: int, tolerance: float = TOLERANCE, per_shard: int = 1) -> list[tuple[int, int]]:
    """n - 1 splitters (h, id), ascending: a row belongs to range k if k of them are at or below its key. keys has h,
    doc_id and size, and is read once a round. per_shard: how many ranges make the unit that the tolerance is a share of."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // n for k in range(1, n)]
    if not total or not targets:
        return [(_HIGH - 1, _HIGH - 1)] * len(targets)
    miss = tolerance * total / n * per_shard
    found = _search(keys.select(F.lit(0).alias("part"), F.col("h").alias("key"), "size"), [(0, t) for t in targets], {0: 0}, miss, 64 - FIRST_DIGIT)
    out = [(cut, _LOW) for cut, _, _ in found]
    if at := [i for i, x in enumerate(found) if x[2]]:
        inside = keys.where(F.col("h").isin(sorted({found[i][0] for i in at})))
        inside = inside.select(F.col("h").alias("part"), F.coalesce("doc_id", F.lit(_LOW)).alias("key"), "size")
        least, most = inside.agg(F.min("key"), F.max("key")).first()
        first = next(s for s in range(64) if (most >> s) - (least >> s) < 2**FIRST_DIGIT)
        ids = _search(inside, [(found[i][0], targets[i]) for i in at], {found[i][0]: found[i][1] for i in at}, miss, first)
        for i, (cut, _, _) in zip(at, ids, strict=True):
            out[i] = (found[i][0], cut)
    return sorted((min(h, _HIGH - 1), min(i, _HIGH - 1)) for h, i in out)


#: Splitters up to which the comparisons are written out as a tree; more are searched in a constant array.
_TREE = 200


def range_of(h: Column, id: Column, cuts: Sequence[tuple[int, int]]) -> Column:
    """Number of splitters at or below the key (h, id)."""
    id = F.coalesce(id, F.lit(_LOW))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        ch, ci = cuts[mid]
        reached = (h > F.lit(ch)) | ((h == F.lit(ch)) & (id >= F.lit(ci)))
        return F.when(reached, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    if len(cuts) <= _TREE:
        return tree(0, len(cuts))
    numbers = lambda k: F.split(F.lit(" ".join(str(c[k]) for c in cuts)), " ").cast("array<bigint>")
    hs, ids = numbers(0), numbers(1)

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        open_, at, it = a["lo"] < a["hi"], F.get(hs, mid), F.get(ids, mid)
        reached = (h > at) | ((h == at) & (id >= it))
        return F.struct(F.when(open_ & reached, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~reached, mid).otherwise(a["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda a: a["lo"])


def shard_by_bytes(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", ranges_per_shard: int = RANGES_PER_SHARD, tolerance: float = TOLERANCE, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: sizes of shards near equal, slots gapless from 0 in key order.

    The keys are written once to the shared folder, for the rounds to read."""
    from pyspark.sql import Window

    keys = written(keyed(docs, id, text), "shard-keys")
    most = max(ranges_per_shard, MAX_RANGES // shards)
    ranges_per_shard = min(most, max(ranges_per_shard, -(-keys.count() // (rows_per_range * shards))))
    cuts = splitters(keys, shards * ranges_per_shard, tolerance, per_shard=ranges_per_shard)
    placed = keys.withColumn("range", range_of(F.col("h"), F.col("doc_id"), cuts))
    counts = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    before, seen = [], 0
    for k in range(shards * ranges_per_shard):
        seen = 0 if k % ranges_per_shard == 0 else seen
        before.append(seen)
        seen += counts.get(k, 0)
    offset = F.get(F.split(F.lit(" ".join(map(str, before))), " ").cast("array<bigint>"), F.col("range"))
    in_range = Window.partitionBy("range").orderBy("h", "doc_id")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(F.col("range") / ranges_per_shard).cast("int").alias("shard"),
        (offset + F.row_number().over(in_range) - 1).alias("slot"),
    )

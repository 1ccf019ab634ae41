"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Each document has the set of its shingles (five words; a shorter text is one shingle). Documents with equal sets are one
class, represented once. A class has a label in each of TREES trees: DEPTH minima, 16 bits each, one after another, so
that labels in byte order are the tree's prefix trie. Matching starts from whole labels. While a pair at the threshold
would not yet share a prefix with the target recall, the prefixes of one more tree are shortened by one minimum
(``floors``); so trees stop at different depths, and a lower threshold or a higher recall goes further up the tries.

Only trie nodes at a tree's floor that hold several classes matter. Below such a node the trie is climbed from the whole
labels: at each depth the classes (or the representatives of deeper nodes) under one prefix are linked to the least of
them, which alone goes on to the shorter prefix. So a group costs one link a member, never its pairs. Connected
candidates are then verified exactly. A component of many classes is cut into blocks, by size of the set first: two sets
can only be similar enough if their sizes are in the same or neighbouring strata, so only such blocks meet, and no pair
that could link is left out. In a block pair shared shingles are counted by matrix products; only counts of links and a
spanning forest leave the task.

Defined results: a null text counts as empty; a text without words links to nothing and is its own class; repeated rows
are copies of each other; the class id is the least id of a component, null only if all its ids are null; an empty table
gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import bits, maybe_in
from .graph import components
from .shared import give_back, text_or_empty, written
from .textvec import flat, mix, word_grams, word_hashes

#: Words of a shingle; least similarity; recall of a pair at that similarity.
SHINGLE, THRESHOLD, RECALL = 5, Fraction(4, 5), 0.9999
#: Trees, minima of a label, and bytes of one.
TREES, DEPTH, WIDTH = 24, 8, 2
#: Classes and shingles of a block; columns shared by more classes than this are multiplied as a dense matrix.
BLOCK, BLOCK_SHINGLES, DENSE = 600, 1_500_000, 32
#: Text bytes that a worker signs at a time, and shingles whose minima are taken together.
SLICE_BYTES, RUN = 2_000_000, 100_000

_SIGNED = "doc_id long, tag long, v binary, n int, labels binary"


def floors(threshold: float, trees: int, deepest: int, recall: float) -> list[int]:
    """Depth at which each tree stops: prefixes are shortened tree by tree until a pair at the threshold shares one with
    the target recall."""
    out, at = [deepest] * trees, 0
    while math.prod(1 - threshold**d for d in out) > 1 - recall and out[at] > 1:
        out[at] -= 1
        at = (at + 1) % trees
    return out


def depth(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The depth of the longest prefixes, all of one length, that find a pair at the threshold with the target recall."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(*flat(texts))
    grams = word_grams(words, SHINGLE)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else word_grams(words[a:b], b - a) if b > a else grams[:0]))
    return out


def minima(every: np.ndarray, first: np.ndarray, trees: int, deepest: int) -> np.ndarray:
    """Labels of sets that stand one after another from the places ``first`` on: (sets, trees * deepest) 16-bit numbers."""
    factors = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, trees * deepest, dtype=np.uint32) | np.uint32(1)
    low = (every >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), len(factors)), np.uint32)
    ends = np.append(first[1:], len(every))
    at = 0
    while at < len(first):  # runs of sets that fit the processor's cache
        to = max(at + 1, int(np.searchsorted(ends, first[at] + RUN, side="right")))
        part, where = low[first[at] : ends[to - 1]], first[at:to] - first[at]
        for k, f in enumerate(factors):
            out[at:to, k] = np.minimum.reduceat(part * f, where)
        at = to
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((out ^ (out >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(16)).astype(">u2")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about SLICE_BYTES of text, the third column."""
    for whole in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield whole.slice(at, to - at)
            at = to


def _signer(trees: int, deepest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, tag, text -> the class (128-bit digest of the set), its size and its labels, tree by tree."""
        for batch in _slices(batches):
            sets = shingle_sets(batch.column(2))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            values, labels = [None] * len(sets), [None] * len(sets)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                first = np.cumsum(sizes[full]) - sizes[full]
                label = minima(every, first, trees, deepest)
                one, two = np.add.reduceat(mix(every), first), np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), first)
                for k, i in enumerate(full):
                    values[i] = one[k].tobytes() + two[k].tobytes()
                    labels[i] = label[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary()), pa.array(sizes, pa.int32()), pa.array(labels, pa.binary())], names=["doc_id", "tag", "v", "n", "labels"])
        give_back()

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share (the diagonal is meaningless)."""
    m = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.append(True, every[1:] != every[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(every)))
    column = np.cumsum(new) - 1
    out = np.zeros((m, m), np.float32)
    wide = np.flatnonzero(size > DENSE)
    for at in range(0, len(wide), 4096):
        some = wide[at : at + 4096]
        a = np.zeros((m, len(some)), np.float32)
        place = np.full(len(size), -1)
        place[some] = np.arange(len(some))
        inside = place[column] >= 0
        a[owner[inside], place[column[inside]]] = 1
        out += a @ a.T
    thin = (size > 1) & (size <= DENSE)
    keep = thin[column]
    column, owner = column[keep], owner[keep]
    flat_ = out.reshape(-1)
    for k in range(1, int(size[thin].max(initial=1))):
        same = column[k:] == column[:-k]
        if not same.any():
            break
        a, b = owner[:-k][same], owner[k:][same]
        cell, times = np.unique(np.concatenate((a * m + b, b * m + a)), return_counts=True)
        flat_[cell] += times
    return out


def forest(adjacent: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component."""
    label = np.arange(len(adjacent))
    while True:
        near = np.where(adjacent, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: Fraction):
    def run(table: pa.Table) -> pa.Table:
        """The classes of one pair of blocks -> per class: its root in here and the documents of the classes it links to."""
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        names = table["v"].to_pylist()
        rows = sorted({v: k for k, v in enumerate(names)}.items())  # repeated rows of a document count once
        pick = np.array([k for _, k in rows])
        names = [v for v, _ in rows]
        text = table["text"].combine_chunks()
        text = (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text).take(pa.array(pick))
        copies, block = table["copies"].to_numpy()[pick], table["block"].to_numpy()[pick]
        sets = shingle_sets(text)
        size = np.array([len(s) for s in sets], np.float64)
        both = intersections(sets).astype(np.float64)
        union = size[:, None] + size[None, :] - both
        linked = both * threshold.denominator >= union * threshold.numerator
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        root = forest(linked)
        links = (linked * copies[None, :]).sum(axis=1).astype(np.int64)
        return pa.table({"v": pa.array(names, pa.binary()), "root": pa.array([names[k] for k in root], pa.binary()), "links": pa.array(links, pa.int64())})

    return run


def trie_links(classes: DataFrame, floor: list[int]) -> DataFrame:
    """classes (v, labels) -> links (a, b) between classes under one prefix, in each tree from whole labels up to its
    floor: a member to the least member, which stands for the node further up."""
    stop = F.array(*[F.lit(d) for d in floor])
    trees = F.sequence(F.lit(0), F.lit(len(floor) - 1))
    label = lambda t: F.substring("labels", t * (DEPTH * WIDTH) + 1, F.lit(DEPTH * WIDTH))
    filed = classes.select("v", F.explode(F.transform(trees, lambda t: F.struct(t.cast("byte").alias("t"), label(t).alias("label")))).alias("x")).select("v", "x.t", "x.label")
    filed = filed.withColumn("node", F.xxhash64("t", F.substring("label", F.lit(1), F.get(stop, F.col("t").cast("int")) * WIDTH)))
    several = filed.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("node")
    several = written(several, "nodes")
    some = maybe_in(filed, F.col("node"), bits(several, F.col("node")))
    level = written(some.join(several, "node").select("t", "label", F.col("v").alias("a")), "trie")
    links = []
    for d in range(DEPTH, min(floor) - 1, -1):
        here = level.where(F.get(stop, F.col("t").cast("int")) <= d).withColumn("p", F.substring("label", 1, d * WIDTH))
        node = here.groupBy("t", "p").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("c"))
        links.append(here.join(node.where("c > 1"), ["t", "p"]).where("a != b").select("a", "b"))
        if d > min(floor):
            level = node.select("t", F.col("p").alias("label"), F.col("b").alias("a"))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out.distinct()


def block_pairs(near: DataFrame, classes: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """near (v, root: candidates) -> v, one, copies, root, block, i, j: the pairs of blocks in which a class is compared.

    A component with few classes and shingles is one block. A larger one has strata by size of the set, in steps of
    1 / threshold, and blocks within strata by a hash of the class; blocks of the same or neighbouring strata meet."""
    member = near.unionByName(near.select(F.col("root").alias("v"), "root").distinct()).join(classes.select("v", "one", "copies", "n"), "v")
    step = math.log(threshold.denominator / threshold.numerator) * 1.0001
    member = member.withColumn("stratum", F.floor(F.log("n") / step).cast("int"))
    blocks = F.ceil(F.greatest(F.sum("c") / block, F.sum("s") / BLOCK_SHINGLES)).cast("int")
    each = member.groupBy("root", "stratum").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    strata = each.groupBy("root").agg(blocks.alias("whole"), F.array_sort(F.collect_list(F.struct("stratum", F.ceil(F.greatest(F.col("c") / block, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("k")))).alias("strata"))  # log of the largest set strata at most
    member = member.join(strata, "root")
    before = lambda upto: F.aggregate(F.filter("strata", lambda x: x["stratum"] < upto), F.lit(0), lambda a, x: a + x["k"])
    own = F.filter("strata", lambda x: x["stratum"] == F.col("stratum"))[0]["k"]
    one = F.col("whole") == 1
    member = member.withColumn("block", F.when(one, 0).otherwise(before(F.col("stratum")) + F.pmod(F.xxhash64("v"), own.cast("long")).cast("int")))
    first, end = F.when(one, 0).otherwise(before(F.col("stratum") - 1)), F.when(one, 1).otherwise(before(F.col("stratum") + 2))
    met = F.transform(F.sequence(first, end - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    return member.select("v", "one", "copies", "root", "block", met.alias("met"))


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, tag (hash of the text), class_id (least id of its component), copy_id (least id with an equal
    set), n_links (other documents at or above the threshold, copies included), is_first (the component's first row)."""
    t = text_or_empty(text)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(t).alias("tag"), t.alias("text"))
    signed = written(rows.mapInArrow(_signer(TREES, DEPTH), _SIGNED), "signatures")
    classes = signed.where(F.col("v").isNotNull()).groupBy("v").agg(
        F.min("doc_id").alias("copy_id"), F.min(F.struct("doc_id", "tag")).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels")
    )
    classes = written(classes, "classes")
    near = components(trie_links(classes, floors(float(threshold), TREES, DEPTH, recall)), "candidates")
    member = written(block_pairs(near, classes, threshold, block), "blocks")
    some = maybe_in(rows, F.struct("doc_id", "tag"), bits(member, F.struct("one.doc_id", "one.tag")))
    same = some["doc_id"].eqNullSafe(F.col("one.doc_id")) & (some["tag"] == F.col("one.tag"))
    asked = some.join(member, same).select("root", "v", "copies", "block", "met", "text").dropDuplicates(["v"])
    pairs = asked.select("root", "v", "copies", "block", "text", F.explode("met").alias("p")).select("root", "v", "copies", "block", "text", "p.i", "p.j")
    found = pairs.groupBy("root", "i", "j").applyInArrow(_verify(threshold), "v binary, root binary, links long")
    found = written(found, "links")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")), "linked")
    named = classes.join(final, "v", "left").select("v", "copy_id", "one", "copies", F.coalesce("root", "v").alias("root"))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("one").alias("first"))
    named = named.join(least, "root").join(links, "v", "left")
    named = named.select("v", "copy_id", "class_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "tag", "v").join(named, "v", "left")
    own = F.col("v").isNull()
    return out.select(
        "doc_id",
        "tag",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (own | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag")))).alias("is_first"),
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that are near copies: of each component the row of the least (id, hash of the text) stays, once,
    and every row without words."""
    held = docs.select(F.struct("*").alias("row"), F.col(id).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("tag"), text_or_empty(text).rlike(r"[^\x20\x09-\x0D]").alias("said"))
    first = join(docs, id, text).where("is_first").select(F.col("doc_id").alias("i"), F.col("tag").alias("t")).distinct()
    kept = held.join(first, held["doc_id"].eqNullSafe(first["i"]) & (held["tag"] == first["t"]), "left_semi")
    return kept.where("said").dropDuplicates(["doc_id", "tag"]).select("row.*").unionByName(kept.where("not said").select("row.*"))

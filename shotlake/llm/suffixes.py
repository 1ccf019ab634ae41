"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

The question is asked of every 50-byte string: does it also start in a document of a smaller id? Only suffixes that can
have an answer are sorted. A pre-filter finds them: the least hash among a string's KEY-byte substrings marks its anchor, so
two equal strings have their anchors at the same place and neighbouring strings mostly share one; the strings of an anchor
make a span.

1. By anchor: a bucket holds the fingerprints of the anchors' KEY bytes. Strings whose anchor no other document has are
   done. A span all of whose bytes (fingerprints of 64 bits, under an anchor of at least 48 more) are those of a span in a
   smaller document is removed whole, so copies are not sorted.
2. The bytes of the spans that are left go to buckets by anchor, and their suffixes are put in order by most-significant-
   digit passes (``equal_strings``): each pass sorts by the next DIGIT bytes within the groups so far, and only groups that
   still hold several documents go on to the next, down to the depth of 50 bytes. Equal groups are then exactly the
   repeated strings; bytes decide, not hashes.

Before the first exchange each task settles equal spans among its own documents, so a passage that a third of all documents
share sends one row a task. An anchor with more than HOT different spans in one task (a rule of dashes, a word between
ever new neighbours) is hot: the task sends such spans on undecided, and a mark, on which the others' spans under this
anchor are undecided too. Strings under hot anchors are dealt by all of their bytes instead of the anchor, each once a
bucket of documents, so that no task has to hold what a hot anchor gathers. Anchors move as packed columns, a blob per task
and bucket; texts move compressed, once, by document.

Defined results: a null text counts as empty; a null id is smaller than any other; documents with the same id are not
smaller than each other; repeated rows each give a row; an empty table gives an empty result; further columns are not
carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_bucket, deltas, from_deltas, pack, ranges, signed, unpack
from .shared import give_back, text_or_empty, written
from .textvec import flat, grams, mix, pieces, sliding_min

#: Bytes of the strings, of an anchor, and of a digit of the sort.
WINDOW, KEY, DIGIT = 50, 20, 8
#: Different spans of one anchor in a task beyond which the anchor is hot.
HOT = 256
#: Text bytes that a task gathers before it sends, and of a bucket of documents; bytes hashed at a time.
FLUSH, BUCKET_BYTES, PIECE = 18_000_000, 8_000_000, 2_000_000
#: Stands for a null id.
NULL_ID = -(2**63)

_ROWS = "bucket int, kind int, blob binary"
_ANCHORS, _FATES, _HOT, _SPELLED, _STRINGS = range(5)
_OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


class Docs:
    """Ids and tags (hash of the text) of the documents that a blob speaks of. A document goes to one bucket."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray):
        self.ids, self.tags = ids.astype(np.int64), tags.astype(np.uint64)

    def bucket(self, n: int) -> np.ndarray:
        return (mix(self.ids.view(np.uint64) ^ mix(self.tags)) % np.uint64(n)).astype(np.int64)

    def parts(self, own: np.ndarray) -> list[tuple[np.ndarray, int]]:
        return [(self.ids[own].view(np.uint64), 8), (self.tags[own], 8)]


def anchors(x: np.ndarray, own: list[tuple[int, int, int, int]], base: int) -> tuple[np.ndarray, ...]:
    """Of a piece of texts: for each anchor its text, the first of its strings (offset in the text), how many, and the
    fingerprints of the anchor and of its span."""
    none = np.zeros(0, np.int64)
    if len(x) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    key, full = grams(x, (KEY, WINDOW))
    n = len(x) - WINDOW + 1
    low = np.uint64(0xFFFFFFFF)
    best = sliding_min((mix(key) & ~low) | np.arange(len(key), dtype=np.uint64), WINDOW - KEY + 1)
    at = (best & low).astype(np.int64)
    starts, ends = np.array([o[1] for o in own]) - base, np.array([o[2] for o in own]) - base
    edge = np.zeros(n + 1, np.int8)
    fit = ends - starts >= WINDOW
    np.add.at(edge, starts[fit], 1)
    np.add.at(edge, ends[fit] - WINDOW + 1, -1)
    valid = np.cumsum(edge[:n]).astype(bool)
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1] | ~valid[1:]
    cut = np.flatnonzero(new)
    length = np.diff(np.append(cut, n))
    first, length = cut[valid[cut]], length[valid[cut]]
    part = np.searchsorted(starts, first, side="right") - 1
    text, shift = np.array([o[0] for o in own])[part], np.array([o[3] for o in own])[part] - starts[part]
    last, place = first + length - 1, at[first]
    span = mix(full[first]) ^ (mix(full[last] + np.uint64(1)) * np.uint64(3)) ^ mix(((place - first) * 64 + length).astype(np.uint64))
    return text, first + shift, length, mix(key[place]), mix(span)


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(2))).as_py() or 0
            if size >= FLUSH:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _fates(docs: Docs, doc: np.ndarray, start: np.ndarray, length: np.ndarray, how: np.ndarray, what: np.ndarray, n: int, kind: int) -> Iterator[tuple]:
    """Rows for the buckets of documents. how: 0 removed, 1 like the strings from what on, 2 undecided under the anchor
    what, 3 undecided under a hot anchor."""
    of = docs.bucket(n)
    for b, i in by_bucket(of[doc]):
        own, local = np.unique(doc[i], return_inverse=True)
        yield b, kind, pack(*docs.parts(own), (deltas(local), 4), (deltas(start[i]), 5), (length[i], 4), (how[i], 1), (what[i], 8))


def _sample(n: int, digit: int, most: int = HOT):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, tag, text -> anchors by bucket of the anchor; settled spans by any bucket, to be passed on."""
        for table in _gathered(batches):
            text = table.column("text").combine_chunks()
            docs = Docs(_ids(table.column("doc_id").combine_chunks()), table.column("tag").to_numpy().view(np.uint64))
            x, bounds = flat(text if isinstance(text, pa.Array) else text.chunk(0))
            got = [anchors(x[a:b], own, a) for a, b, own in pieces(bounds, PIECE, WINDOW - 1)]
            doc, start, length, key, span = (np.concatenate(c) for c in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
            ids = docs.ids[doc]
            order = np.lexsort((start, doc, ids, span, key))
            doc, start, length, key, span, ids = (c[order] for c in (doc, start, length, key, span, ids))
            new = np.ones(len(doc), bool)
            new[1:] = (key[1:] != key[:-1]) | (span[1:] != span[:-1])
            group = np.cumsum(new) - 1
            least = ids[new][group]
            again = ~new & (np.append(-1, doc[:-1]) == doc)  # the same document, right before
            run_ = np.flatnonzero(~again)
            leader = start[run_][np.cumsum(~again) - 1]
            later = ids > least
            apart = np.append(True, key[1:] != key[:-1])[: len(key)]
            which = np.cumsum(apart) - 1
            hot = (np.bincount(which, weights=new & ~later) > most)[which] if len(key) else new
            fate, rows = later | again | hot, []
            bucket = (key % np.uint64(n)).astype(np.int64)
            for b, i in by_bucket(bucket[~fate]):
                i = np.flatnonzero(~fate)[i]
                i = i[np.lexsort((start[i], doc[i]))]
                own, local = np.unique(doc[i], return_inverse=True)
                rows.append((b, _ANCHORS, pack(*docs.parts(own), (deltas(local), 4), (deltas(start[i]), 5), (length[i], 4), (key[i] // np.uint64(n), digit), (span[i], 8))))
            if hot.any():
                some = np.flatnonzero(hot & apart)
                rows += [(b, _HOT, pack((key[some[i]] // np.uint64(n), digit))) for b, i in by_bucket(bucket[some])]
            # settled here: a smaller document of this task has the span, or the same one has it before
            if fate.any():
                how = np.where(later[fate], 0, np.where(again[fate], 1, 3))
                rows += _fates(docs, doc[fate], start[fate], length[fate], how, np.where(how == 1, leader[fate], 0), n, _FATES)
            for at in range(0, len(rows), 16):
                yield _batches(rows[at : at + 16])
        give_back()

    return run


def _settle(n: int):
    def run(table: pa.Table) -> pa.Table:
        """A bucket of anchors -> fates by bucket of documents; others pass."""
        rows, parts, ids, tags, hot, base = [], [], [], [], [], 0
        for b, kind, blob in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["blob"], strict=True):
            if kind == _FATES:
                rows.append((b, kind, blob.as_py()))
            elif kind == _HOT:
                hot.append(unpack(blob.as_py())[0])
            else:
                i, t, local, start, length, key, span = unpack(blob.as_py())
                ids.append(signed(i))
                tags.append(t)
                parts.append((from_deltas(local) + base, from_deltas(start), length.astype(np.int64), key, span))
                base += len(i)
        if parts:
            docs = Docs(np.concatenate(ids), np.concatenate(tags))
            doc, start, length, key, span = (np.concatenate(c) for c in zip(*parts, strict=True))
            own = docs.ids[doc]
            order = np.lexsort((start, own, span, key))
            doc, start, length, key, span, own = (c[order] for c in (doc, start, length, key, span, own))
            new_key = np.append(True, key[1:] != key[:-1])
            new_span = new_key | np.append(True, span[1:] != span[:-1])
            removed = own > own[new_span][np.cumsum(new_span) - 1]
            which = np.cumsum(new_key) - 1
            at = np.flatnonzero(new_key)
            several = (np.add.reduceat(new_span.astype(np.int64), at) > 1) & (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at))
            marked = np.isin(key[at], np.concatenate(hot)) if hot else np.zeros(len(at), bool)
            keep = removed | (several | marked)[which]
            how = np.where(removed, 0, np.where(marked[which], 3, 2))[keep]
            rows += _fates(docs, doc[keep], start[keep], length[keep], how, np.where(how == 2, key[keep], np.uint64(0)), n, _FATES)
        return pa.Table.from_batches([_batches(rows)])

    return run


class Texts:
    """The documents of a bucket, by (id, tag)."""

    def __init__(self, blobs: list[bytes]):
        z = zstandard.ZstdDecompressor()
        self.ids, self.text = [], []
        for blob in blobs:
            cut = int.from_bytes(blob[:8], "little")
            ids, tags, sizes = unpack(blob[8 : 8 + cut])
            data, at = z.decompress(blob[8 + cut :]), 0
            for i, t, s in zip(signed(ids).tolist(), tags.tolist(), sizes.tolist(), strict=True):
                self.ids.append((i, t))
                self.text.append(np.frombuffer(data, np.uint8, s, at))
                at += s
        self.of: dict[tuple[int, int], list[int]] = {}
        for k, x in enumerate(self.ids):
            self.of.setdefault(x, []).append(k)


def _packed_texts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, tag, text -> texts by bucket of documents."""
        for table in _gathered(batches):
            docs = Docs(_ids(table.column("doc_id").combine_chunks()), table.column("tag").to_numpy().view(np.uint64))
            text = table.column("text").combine_chunks()
            x, bounds = flat(text if isinstance(text, pa.Array) else text.chunk(0))
            rows, z = [], zstandard.ZstdCompressor(3)
            for b, i in by_bucket(docs.bucket(n)):
                head = pack(*docs.parts(i), (bounds[i + 1] - bounds[i], 5))
                body = z.compress(b"".join(x[bounds[k] : bounds[k + 1]].tobytes() for k in i))
                rows.append((b, 0, len(head).to_bytes(8, "little") + head + body))
            for at in range(0, len(rows), 16):
                yield _batches(rows[at : at + 16])

    return run


def _read_fates(table: pa.Table) -> dict[tuple[int, int], list[tuple[np.ndarray, ...]]]:
    """(id, tag) -> [(start, length, how, what)]."""
    out: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
    for blob in table["blob"]:
        ids, tags, local, start, length, how, what = unpack(blob.as_py())
        local, start = from_deltas(local), from_deltas(start)
        order = np.argsort(local, kind="stable")
        cut = np.searchsorted(local[order], np.arange(len(ids) + 1))
        for k, x in enumerate(zip(signed(ids).tolist(), tags.tolist(), strict=True)):
            i = order[cut[k] : cut[k + 1]]
            out.setdefault(x, []).append((start[i], length[i].astype(np.int64), how[i], what[i]))
    return out


def equal_strings(x: np.ndarray, at: np.ndarray, group: np.ndarray, ids: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Which of the strings of depth bytes that begin at the places ``at`` of x also belong to a smaller id, among those of
    one group (a number each). Most-significant-digit passes: the strings are ordered by group and their next DIGIT bytes;
    equal ones make the groups of the next pass, and groups with one id are done."""
    out = np.zeros(len(at), bool)
    padded = np.concatenate((x, np.zeros(DIGIT, np.uint8)))
    digits = np.ndarray((len(x) + 1,), ">u8", buffer=padded, strides=(1,))
    left = np.arange(len(at))
    group = np.unique(group, return_inverse=True)[1]
    for d in range(0, depth, DIGIT):
        digit = digits[at[left] + d].astype(np.uint64) >> np.uint64(8 * max(0, d + DIGIT - depth))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))[: len(left)]
        if not len(left):
            return out
        first = np.flatnonzero(new)
        least, most = np.minimum.reduceat(ids[left], first), np.maximum.reduceat(ids[left], first)
        group = np.cumsum(new) - 1
        on = (least < most)[group]
        left, group, least = left[on], group[on], least[group[on]]
    out[left] = ids[left] > least
    return out


def _spelled(n: int):
    def run(texts: pa.Table, fates: pa.Table) -> pa.Table:
        """The bytes of undecided spans by bucket of the anchor, and strings under hot anchors by bucket of all their bytes."""
        own, told = Texts([x.as_py() for x in texts["blob"]]), _read_fates(fates)
        docs = Docs(np.array([i for i, _ in own.ids], np.int64), np.array([t for _, t in own.ids], np.uint64))
        base = np.concatenate(([0], np.cumsum([len(t) for t in own.text]))).astype(np.int64)
        x = np.concatenate(own.text) if own.text else np.zeros(0, np.uint8)
        got: dict[int, list] = {2: [], 3: []}
        for k, key in enumerate(own.ids):
            if own.of[key][0] != k or key not in told:
                continue
            start, length, how, what = (np.concatenate(c) for c in zip(*told[key], strict=True))
            for h in (2, 3):
                if (ask := how == h).any():
                    got[h].append((np.full(int(ask.sum()), k), start[ask], length[ask], what[ask]))
        rows = []
        if got[2]:
            doc, start, length, what = (np.concatenate(c) for c in zip(*got[2], strict=True))
            # the anchor lost its remainder by the number of buckets; any spreading by it keeps equal ones together
            for b, i in by_bucket((mix(what) % np.uint64(n)).astype(np.int64)):
                i = i[np.lexsort((start[i], doc[i]))]
                o, local = np.unique(doc[i], return_inverse=True)
                spelled = x[ranges(base[doc[i]] + start[i], length[i] + WINDOW - 1)]
                rows.append((b, _SPELLED, pack(*docs.parts(o), (deltas(local), 4), (deltas(start[i]), 5), (length[i], 4), (what[i], 8), (spelled, 1))))
        if got[3]:
            doc, start, length, _ = (np.concatenate(c) for c in zip(*got[3], strict=True))
            doc, start = np.repeat(doc, length), ranges(start, length)
            rows += _hot_strings(docs, x, base, doc, start, n)
        return pa.Table.from_batches([_batches(rows)])

    return run


def _hot_strings(docs: Docs, x: np.ndarray, base: np.ndarray, doc: np.ndarray, start: np.ndarray, n: int) -> Iterator[tuple]:
    """Strings under hot anchors, dealt by a hash of their bytes: of a document's equal ones the first, the others like it;
    of equal ones of several documents those of the least id, the others removed."""
    hashes = np.zeros(len(doc), np.uint64)
    at = base[doc] + start
    order = np.argsort(at)
    for a in range(0, len(at), PIECE // WINDOW):
        i = order[a : a + PIECE // WINDOW]
        some = x[ranges(at[i], np.full(len(i), WINDOW))]
        hashes[i] = mix(grams(some, (WINDOW,))[0][::WINDOW])
    gone = equal_strings(x, at, hashes, docs.ids[doc])
    order = np.lexsort((start, doc, hashes))
    same = np.zeros(len(doc), bool)
    if len(order) > 1:
        i, j = order[:-1], order[1:]
        same[j] = (hashes[i] == hashes[j]) & (doc[i] == doc[j])
        if (k := np.flatnonzero(same)).size:  # by their bytes too
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(order))
            before = order[place[k] - 1]
            w = np.arange(WINDOW)
            for a in range(0, len(k), PIECE // WINDOW):
                s = slice(a, a + PIECE // WINDOW)
                same[k[s]] = (x[at[k[s], None] + w] == x[at[before[s], None] + w]).all(axis=1)
    ordered = order[~same[order]]
    leader = np.empty(len(doc), np.int64)
    leader[order] = start[ordered][np.cumsum(~same[order]) - 1]
    done = gone | same
    if done.any():
        d = np.flatnonzero(done)
        how = np.where(gone[d], 0, 1)
        yield from _fates(docs, doc[d], start[d], np.ones(len(d), np.int64), how, np.where(how == 1, leader[d], 0), n, _FATES)
    sent = np.flatnonzero(~done)
    for b, i in by_bucket((hashes[sent] % np.uint64(n)).astype(np.int64)):
        i = sent[i]
        i = i[np.lexsort((start[i], doc[i]))]
        o, local = np.unique(doc[i], return_inverse=True)
        yield b, _STRINGS, pack(*docs.parts(o), (deltas(local), 4), (deltas(start[i]), 5), (hashes[i], 8), (x[ranges(at[i], np.full(len(i), WINDOW))], 1))


def _sorted(n: int):
    def run(table: pa.Table) -> pa.Table:
        """Suffixes of a bucket -> those whose string a smaller document has, as fates by bucket of documents; others pass."""
        rows, ids, tags, text, parts, base, at = [], [], [], [], [], 0, 0
        for b, kind, blob in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["blob"], strict=True):
            if kind == _FATES:
                rows.append((b, kind, blob.as_py()))
                continue
            i, t, local, start, *rest = unpack(blob.as_py())
            length = rest[0].astype(np.int64) if kind == _SPELLED else np.ones(len(start), np.int64)
            what, spelled = rest[-2], rest[-1].astype(np.uint8)
            ids.append(signed(i))
            tags.append(t)
            text.append(spelled)
            size = length + WINDOW - 1
            # hot strings never meet spans: their groups have numbers of their own
            parts.append((np.repeat(from_deltas(local) + base, length), ranges(from_deltas(start), length), np.repeat(mix(what ^ np.uint64(kind)), length), ranges(np.cumsum(size) - size + at, length)))
            base, at = base + len(i), at + len(spelled)
        if parts:
            docs = Docs(np.concatenate(ids), np.concatenate(tags))
            doc, start, group, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            removed = equal_strings(np.concatenate(text), place, group, docs.ids[doc])
            doc, start = doc[removed], start[removed]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            # neighbouring strings of a document go as one fate
            at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))[: len(doc)])
            zero = np.zeros(len(at), np.uint64)
            if len(at):
                rows += _fates(docs, doc[at], start[at], np.diff(np.append(at, len(doc))), zero, zero, n, _FATES)
        return pa.Table.from_batches([_batches(rows)])

    return run


def covered(size: int, fates: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Which bytes of a text of so many bytes lie in a removed string."""
    if size < WINDOW or not fates:
        return np.zeros(size, bool)
    start, length, how, what = (np.concatenate(c) for c in zip(*fates, strict=True))
    w = np.zeros(size - WINDOW + 1, bool)
    w[ranges(start[how == 0], length[how == 0])] = True
    for one in (True, True, False):  # a single string may be like one that is like another; longer spans are like either
        like = (how == 1) & ((length == 1) == one)
        w[ranges(start[like], length[like])] |= w[ranges(what[like].astype(np.int64), length[like])]
    edge = np.zeros(size + 1, np.int32)
    hit = np.flatnonzero(w)
    edge[hit] += 1
    edge[hit + WINDOW] -= 1
    return np.cumsum(edge[:size]) > 0


def _cut(texts: pa.Table, fates: pa.Table) -> pa.Table:
    own, told = Texts([x.as_py() for x in texts["blob"]]), _read_fates(fates)
    sizes, spans, kept = [], [], []
    for key, x in zip(own.ids, own.text, strict=True):
        gone = covered(len(x), told.get(key, []))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
        sizes.append(len(x))
        spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        kept.append(x[~gone].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ids = pa.array([None if i == NULL_ID else i for i, _ in own.ids], pa.int64())
    return pa.Table.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed runs of bytes), kept (the bytes that stay)."""
    t = text_or_empty(text)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(t).alias("tag"), t.cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length(t).cast("long"))).first()[0] or 0
    n = max(8, total // bucket_bytes + 1)
    digit = min(8, math.ceil((math.log2(total + 2) + 12 - math.log2(n)) / 8))
    by = lambda df: df.repartition(n, "bucket").groupBy("bucket")
    first = rows.mapInArrow(_sample(n, digit, hot), _ROWS)
    fates = written(by(first).applyInArrow(_settle(n), _ROWS), "fates")
    texts = rows.mapInArrow(_packed_texts(n), _ROWS)
    spelled = by(texts).cogroup(by(fates)).applyInArrow(_spelled(n), _ROWS)
    more = by(spelled).applyInArrow(_sorted(n), _ROWS)
    return by(texts).cogroup(by(fates.unionByName(more))).applyInArrow(_cut, _OUT)

"""Hashes of bytes and words over many texts at once, as NumPy arrays.

Texts stand one after another in one array of bytes. Hashes are polynomials modulo 2**64 over a fixed random value per
byte, so a hash depends on the bytes alone, whatever process computes it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Base of the polynomials and the value of each byte, from a fixed seed.
_RNG = np.random.Generator(np.random.PCG64(20240229))
BASE = int(_RNG.integers(1 << 62, 1 << 63)) * 2 + 1
BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Value of each byte within a word (white space has none), and odd factors by the place in it.
_IN_WORD = np.where(_SPACE, np.uint64(0), BYTE)
_PLACES = 4096
_PLACE = _RNG.integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and their bounds (one more than texts). Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """Cuts the texts into runs of about size bytes: (start, end, [(text, its part's start, end, offset in the text)]).
    A text longer than size comes in parts that share overlap bytes, cut at multiples of size from its start."""
    own: list[tuple[int, int, int, int]] = []
    for t in range(len(bounds) - 1):
        a, b = int(bounds[t]), int(bounds[t + 1])
        if own and b - own[0][1] > size:
            yield own[0][1], own[-1][2], own
            own = []
        if b - a <= size:
            own.append((t, a, b, 0))
            continue
        for at in range(a, max(b - overlap, a + 1), size):
            end = min(b, at + size + overlap)
            yield at, end, [(t, at, end, at - a)]
    if own:
        yield own[0][1], own[-1][2], own


def grams(x: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length the hashes of all runs of so many bytes of x (shorter than x by length - 1)."""
    by = {1: BYTE[x]}
    k = 1
    while 2 * k <= max(lengths):
        h = by[k]
        by[2 * k] = h[: len(h) - k] * power(k) + h[k:] if len(h) > k else h[:0]
        k *= 2
    out = []
    for n in lengths:
        h, done = None, 0
        for p in sorted((p for p in by if n & p), reverse=True):
            size = max(0, len(x) - done - p + 1)
            h = by[p] if h is None else h[:size] * power(p) + by[p][done : done + size]
            done += p
        out.append(h)
    return out


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive keys."""
    if len(key) < width:
        return key[:0]
    k = 1
    while 2 * k <= width:
        key = np.minimum(key[: len(key) - k], key[k:])
        k *= 2
    rest = width - k
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


#: Bytes hashed at a time; a piece ends at white space.
WORD_PIECE = 1 << 18


def word_hashes(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than ASCII white space) of all texts, and the bounds of each text's."""
    hashes, docs = [], []
    at = 0
    while at < len(x):
        end = min(len(x), at + WORD_PIECE)
        while end < len(x) and not _SPACE[x[end - 1]] and end not in _Bounds(bounds):
            step = x[end : end + WORD_PIECE]
            space = np.flatnonzero(_SPACE[step])
            cut = np.searchsorted(bounds, end)
            edge = int(bounds[cut]) if cut < len(bounds) else len(x)
            end = min(edge, end + int(space[0]) + 1 if len(space) else end + len(step))
        part = x[at:end]
        lone = _SPACE[part]
        start = ~lone
        start[1:] &= lone[:-1]
        inner = bounds[np.searchsorted(bounds, at, side="right") : np.searchsorted(bounds, end)] - at
        start[inner] = ~lone[inner]
        first = np.flatnonzero(start)
        if len(first):
            place = np.arange(len(part))
            place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(part))))
            value = _IN_WORD.take(part)
            if (far := np.flatnonzero(place >= _PLACES)).size:
                far = far[~lone[far]]
                value[far] = mix(value[far] + (place[far] // _PLACES).astype(np.uint64))
            value *= _PLACE.take(place & (_PLACES - 1))
            hashes.append(np.add.reduceat(value, first))
            docs.append(np.searchsorted(bounds, first + at, side="right") - 1)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    doc = np.concatenate(docs)
    return mix(np.concatenate(hashes)), np.searchsorted(doc, np.arange(len(bounds)))


class _Bounds:
    """Membership in sorted bounds."""

    def __init__(self, bounds: np.ndarray):
        self.bounds = bounds

    def __contains__(self, at: int) -> bool:
        k = np.searchsorted(self.bounds, at)
        return k < len(self.bounds) and self.bounds[k] == at


def word_grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (across texts too: the caller leaves those out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * power(1) + words[j : j + n]
    return mix(h + np.uint64(k))

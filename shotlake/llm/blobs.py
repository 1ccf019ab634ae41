"""Columns of numbers packed into one binary value, so that a shuffle moves a row per task and bucket, not per number."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_LEVEL = 3


def planes(a: np.ndarray, width: int) -> np.ndarray:
    """The low width bytes of unsigned numbers, byte by byte, all lowest first."""
    if a.dtype == np.uint8 and width == 1:
        return a
    a = np.ascontiguousarray(a.astype("<u8"))
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def from_planes(data: np.ndarray, width: int) -> np.ndarray:
    """planes() back as 64-bit numbers; of width 1 as bytes."""
    if width == 1:
        return data
    n = len(data) // width if width else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data.reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack(*parts: tuple[np.ndarray, int]) -> bytes:
    """Unsigned columns, each with the bytes that its values need, compressed together."""
    out = [struct.pack("<B", len(parts))]
    for a, width in parts:
        data = planes(a, width).tobytes()
        out += [struct.pack("<BQ", width, len(data)), data]
    return zstandard.ZstdCompressor(_LEVEL).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(data[0]):
        width, n = struct.unpack_from("<BQ", data, at)
        out.append(from_planes(np.frombuffer(data, np.uint8, n, at + 9), width))
        at += 9 + n
    return out


def signed(a: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers read as signed ones."""
    return a.view("<i8")


def deltas(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours as unsigned numbers, small ones (of either sign) small."""
    d = np.diff(a.astype(np.int64), prepend=np.int64(0))
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def from_deltas(u: np.ndarray) -> np.ndarray:
    d = (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)
    return np.cumsum(d)


def by_bucket(bucket: np.ndarray):
    """(bucket, indices of its members in order) of each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + length[0] - 1, start[1], ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)

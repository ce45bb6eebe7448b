"""Numpy kernels over the raw UTF-8 of an Arrow batch: prefix polynomial hashes.

hash(s, e) = sum of (byte + 1) * B^(i - s), modulo 2^64, for any stretch in O(1)
from prefix sums.  Work goes in slices of 1 MB, so memory is bounded by the
slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n, kept between calls; ``base`` numbers independent bases."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        size = max(n, SLICE + 1)
        root = pow(BASE, 4 * base + 1, 1 << 64)
        both = []
        for b in (root, pow(root, -1, 1 << 64)):
            t = np.full(size, b, U)
            t[0] = 1
            both.append(np.cumprod(t, out=t))
        _TABLES[base] = (both[0], both[1])
    up, down = _TABLES[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefixes(data: np.ndarray, base: int = 0) -> np.ndarray:
    """P with hash(s, e) = (P[e] - P[s]) * B^-s; one longer than the data."""
    pow_, _ = powers(len(data) + 1, base)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * pow_[:-1], out=out[1:])
    return out


def stretches(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    _, inv = powers(len(pre), base)
    return (pre[ends] - pre[starts]) * inv[starts]


def windows(pre: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """Hash of every stretch of the width."""
    _, inv = powers(len(pre), base)
    return (pre[width:] - pre[:-width]) * inv[: len(pre) - width]


def slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of the column up to ``most`` bytes (SLICE) or one row."""
    most = most or SLICE
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def chunks(column: pa.Array, width: int, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Like ``slices``, with texts of over ``most`` bytes in parts: (..., where the part begins in its text).

    Parts overlap by width - 1 bytes, so every stretch of ``width`` bytes is in exactly one.
    """
    most = most or SLICE
    for lo, hi, data, offs in slices(column, most):
        if len(data) <= most + width:
            yield lo, hi, data, offs, 0
            continue
        for at in range(0, len(data) - width + 1, most):
            part = data[at : at + most + width - 1]
            yield lo, hi, part, np.array([0, len(part)]), at


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches without blanks, and for each text its first one (and the end)."""
    solid = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)

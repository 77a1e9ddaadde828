"""Vectorised word hashing over Arrow string columns, shared by the operators of this package.

Words are the runs ``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial over random 64-bit byte
values, finished by a bit mixer; equal words always agree, and different words of any corpus differ
but for the chance collisions of 64 random bits. Texts are taken in slices of about a megabyte, so memory
stays bounded however many rows a batch has; a longer text is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        kept = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE:
            _powers[str(base)] = kept
    return kept


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of all words; ``offsets`` start at 0."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    last[edges[1:] - 1] = inside[edges[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash of each span of ``data``."""
    values = BYTES[LOWER[data]] if lower else BYTES[data]
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(BASE, n)[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * _power(INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) slice by slice."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, rows = word_spans(part, at)
        yield lo, hi, span_hashes(part, starts, ends, lower), rows


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` neighbouring words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(width):
        factor = (factor * int(BASE) + 2 * k) % (1 << 64)
        out += hashes[k : k + n] * np.uint64(factor | 1)
    return mix(out)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes). A text of fewer words is one shingle; one without words has none."""
    short = mix(np.arange(1, width + 1, dtype=np.uint64))
    for lo, hi, hashed, at in words(column):
        runs = windows(hashed, width)
        for row in range(lo, hi):
            a, b = int(at[row - lo]), int(at[row - lo + 1])
            if b - a >= width:
                yield row, np.unique(runs[a : b - width + 1])
            elif b > a:
                yield row, windows(hashed[a:b], b - a) ^ short[b - a - 1]
            else:
                yield row, np.zeros(0, dtype=np.uint64)

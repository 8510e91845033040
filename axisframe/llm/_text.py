"""Vectorised hashing of words and word windows over Arrow string buffers (small helpers inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_MULT = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Bytes of text hashed at a time: bounds the working arrays, not the texts. The smaller number is for work with many arrays.
CHUNK, SMALL_CHUNK = 1 << 20, 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            size = max(n, CHUNK)
            for k, p in enumerate((_P, _P_INV)):
                x = np.full(size, p, np.uint64)
                x[0] = 1
                _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What the code points of most texts are mixed to.
_LOW_CODES = mix(np.arange(1, 4097, dtype=np.uint64))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, row offsets into the bytes) of runs of rows of about ``size`` bytes; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; a span's hash is :func:`span_hash`."""
    pw, _ = _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=out[1:])
    return out


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and the texts' offsets in them."""
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), lead[off]


def prefix_hash_codes(code: np.ndarray) -> np.ndarray:
    """As :func:`prefix_hash`, over code points."""
    pw, _ = _grow(len(code) + 1)
    out = np.zeros(len(code) + 1, np.uint64)
    value = _LOW_CODES[code] if not len(code) or code.max() < len(_LOW_CODES) else mix(code.astype(np.uint64) + np.uint64(1))
    np.cumsum(value * pw[: len(code)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _grow(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * _MULT[63])


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of each maximal run of bytes that aren't ``space``, never across rows."""
    if lower:
        data = LOWER[data]
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(off, s, "right") - 1
    return s, e, row, span_hash(prefix_hash(data), s, e)


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``k`` words inside one row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out += h[at + i] * _MULT[i]
    return at, mix(out)

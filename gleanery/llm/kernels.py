"""Vectorised text kernels over Arrow batches: words, their 64-bit hashes, and windows of them.

A batch's texts are taken as one UTF-8 buffer with offsets (no Python strings are made). Buffers are
handled in pieces of about ``CHUNK`` bytes cut at word boundaries, so that temporary arrays stay small
however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

U64 = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on an array of uint64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


mix64 = _splitmix

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _splitmix(np.arange(256, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, CHUNK)
_INV = _powers(_INVERSE, CHUNK)


def _separators(extra: bytes = b"") -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E), *extra]] = True
    return table


#: White space: 0x20 and 0x09 to 0x0D.
BLANKS = _separators()
#: Everything of ASCII but letters and digits.
NOT_ALNUM = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])
#: The line feed alone.
NEWLINE = np.array([b == 0x0A for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or of one document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _edges(sep: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without separators; none goes over a cut."""
    n = len(sep)
    start = np.empty(n, dtype=bool)
    word = ~sep
    start[0] = word[0]
    np.logical_and(word[1:], sep[:-1], out=start[1:])
    end = np.empty(n, dtype=bool)
    end[-1] = word[-1]
    np.logical_and(word[:-1], sep[1:], out=end[:-1])
    inner = cuts[(cuts > 0) & (cuts < n)]
    start[inner] = word[inner]
    before = inner - 1
    end[before] |= word[before]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Words:
    """Words of a slice of documents: byte starts and ends, hashes, and where each document's words begin."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, starts, ends, hashes, first):
        self.starts, self.ends, self.hashes, self.first = starts, ends, hashes, first


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = BLANKS, lower: bool = True) -> Words:
    """Words of the texts ``buf[off[i]:off[i+1]]``: maximal runs of bytes that ``sep`` doesn't mark.

    ``lower`` folds A-Z before hashing. ``first`` has len(off) entries: words of document i are
    ``first[i]:first[i+1]``.
    """
    n = len(buf)
    s_all, e_all, h_all = [], [], []
    at = 0
    while at < n:
        stop = min(n, at + CHUNK)
        if stop < n:  # back to a separator, or on to the next one if a word fills the chunk
            tail = np.flatnonzero(sep[buf[at:stop]])
            if len(tail):
                stop = at + int(tail[-1]) + 1
            else:
                step = stop
                while step < n and not len(hit := np.flatnonzero(sep[buf[step : step + CHUNK]])):
                    step += CHUNK
                stop = min(n, step + int(hit[0]) + 1) if step < n else n
        piece = buf[at:stop]
        lo, hi = np.searchsorted(off, [at, stop])
        s, e = _edges(sep[piece], off[lo:hi] - at)
        if len(s):
            if len(piece) <= len(_POW):
                pow_, inv = _POW, _INV
            else:
                pow_, inv = _powers(_BASE, len(piece)), _powers(_INVERSE, len(piece))
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[_LOWER[piece] if lower else piece] * pow_[: len(piece)], out=sums[1:])
            h = _splitmix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64))
            s_all.append(s + at)
            e_all.append(e + at)
            h_all.append(h)
        at = stop
    starts = np.concatenate(s_all) if s_all else np.zeros(0, np.int64)
    ends = np.concatenate(e_all) if e_all else np.zeros(0, np.int64)
    hashes = np.concatenate(h_all) if h_all else np.zeros(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, off))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    mult = 1
    for j in range(k):
        out += h[j : j + m] * U64(mult)
        mult = mult * _INVERSE % (1 << 64)
    return _splitmix(out + U64(k))


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, Spark's long."""
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return h.view(np.uint64)

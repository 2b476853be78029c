"""Vectorised word hashing over the UTF-8 buffer of an Arrow text column.

A polynomial prefix sum over the bytes gives the hash of every word of a batch
with a handful of NumPy calls; no Python object is made per word.  Bytes are
worked through in pieces cut between words, so temporary memory is bounded
however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _lut(keep) -> np.ndarray:
    """Byte -> value; 0 marks a separator, A-Z count as a-z."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        if keep(b):
            t[b] = (b + 32 if 65 <= b <= 90 else b) + 1
    return t


#: Words are runs of anything but ASCII white space.
SPACED = _lut(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = _lut(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables_for(n: int):
    size = PIECE
    while size < n:
        size *= 2
    if size not in _tables:
        _tables[size] = (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray):
    """Byte ranges of about PIECE bytes that end at a row's end or a separator."""
    lo, end = 0, len(data)
    while lo < end:
        hi = min(lo + PIECE, end)
        if hi < end:
            row_end = offsets[np.searchsorted(offsets, hi, side="right") - 1]
            if row_end > lo:
                hi = int(row_end)
            else:  # inside one long row: back to its last separator, or on to the next
                stops = np.flatnonzero(lut[data[lo:hi]] == 0)
                if len(stops):
                    hi = lo + int(stops[-1]) + 1
                else:
                    row_end = int(offsets[np.searchsorted(offsets, hi, side="left")])
                    while hi < row_end and lut[data[hi]] != 0:
                        hi += 1
        yield lo, hi
        lo = hi


def words(column, lut: np.ndarray, spans: bool = False, prefixes: tuple[int, ...] = ()):
    """(hashes, bounds[, starts, ends][, prefix hashes]) of a string column: row
    ``i`` has the word hashes ``hashes[bounds[i]:bounds[i + 1]]``; starts and
    ends are byte positions in :func:`text_buffer`.  For each length in
    ``prefixes`` one more array has the hashes of the words' first bytes, 0
    where a word is not longer."""
    data, offsets = text_buffer(column)
    row_starts = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    hashes, starts, ends, heads = [], [], [], [[] for _ in prefixes]
    for lo, hi in _pieces(data, offsets, lut):
        power, inverse = _tables_for(hi - lo)
        value = lut[data[lo:hi]]
        inside = value != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = row_starts[np.searchsorted(row_starts, lo):np.searchsorted(row_starts, hi)] - lo
        first[cut] = inside[cut]
        last = np.empty_like(first)
        last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
        last[-1] = inside[-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if not len(s):
            continue
        value *= power[:hi - lo]
        total = np.add.accumulate(value)
        h = (total[e] - total[s] + value[s]) * inverse[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        for k, out in zip(prefixes, heads):
            longer = e - s >= k
            part = (total[np.minimum(s + k - 1, e)] - total[s] + value[s]) * inverse[s]
            out.append(np.where(longer, mix(part + np.uint64(k)), np.uint64(0)))
        starts.append(s + lo)
        ends.append(e + 1 + lo)
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    hashes, starts, ends = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
    bounds = np.searchsorted(starts, offsets)
    out = (hashes, bounds, starts, ends) if spans else (hashes, bounds)
    return (*out, *(join(h, np.uint64) for h in heads)) if prefixes else out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word (rows run on; the
    caller leaves out windows that cross a row's end)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += hashes[j:j + n] * np.uint64(pow(0xA24BAED4963EE407, 2 * j + 1, 1 << 64))
    return mix(out + np.uint64(size))

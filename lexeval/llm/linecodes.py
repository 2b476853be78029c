"""Signatures of normalised lines over Arrow batches: word codes, 128-bit
hashes, SimHashes and the rarest word pairs, with NumPy calls over all lines of
a batch at a time.

A line's words are the runs of its lower-cased text without ASCII and common
other punctuation and white space.  Each word is one of ``SYMBOLS`` characters
by its hash, two bytes each (UTF-16, big-endian), so that Spark's edit distance
counts words.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from lexeval.llm.words import ALNUM, mix, words
from lexeval.operators.kernels import edit_distance

#: Characters that stand for words, the first of them, and the size of a table over them.
SYMBOLS, FIRST, TABLE = 55_000, 256, 1 << 16
#: Characters of text and words that are worked on at once (or one longer line).
CHARS, WORDS = 1 << 22, 1 << 18
#: Longs of a line's parity bits.
MAP = 4
#: Keys that similar lines are sure to share: this many, in longer lines one for each so many words.
COMMON, PER_COMMON = 4, 16
#: Counters of hashed word pairs, the counters in a row, and the largest class of a pair's count.
PAIR_BITS, CHUNK, HEAVIEST = 20, 1 << 14, 63
PAIRS = 1 << PAIR_BITS
#: Rows that a task holds before it deals them, and rows of a message of crowded keys.
HELD, MESSAGE = 1 << 19, 1 << 16
#: Pairs of fitting lengths that a key may give for each of its rows; keys of more are crowded.
CROWD = 8
#: Columns of dealt block keys, word pair keys and pairs of lines, and of rows of crowded keys.
BLOCKED, KEYS, MET, CROWDED = ("<i8", "<i8"), ("<i8", "<i8", "<i4"), ("<i8", "<i8", "<i4"), ("<i8", "<i8", "<i8", "<i4")
#: Separators besides ASCII's: C1 and Latin-1 punctuation, general and CJK punctuation.
_WIDE = re.compile("[\x80-\xbf -⁯　-〃]")
#: Words that one byte can count, and each byte's bits as bytes of a long.
LANE, _LANES = 255, np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_ODD = (0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    text = text.lower()
    return text if text.isascii() else _WIDE.sub(" ", text)


def _positions(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(starts, count)


def line_hash(hashes: np.ndarray, starts: np.ndarray, count: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each line's word sequence; no line is empty."""
    power = np.full(int(count.max()), _ODD[which], np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    own = hashes if which == 0 else mix(hashes + np.uint64(which))
    return mix(np.add.reduceat(own * power[_positions(starts, count)], starts) + count.astype(np.uint64))


def simhash(hashes: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits that more than half of each line's word hashes have.  Eight bits
    are counted in one sum, a byte each, over pieces of no more than LANE words."""
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + WORDS)))
        a, b = int(starts[lo]), int(starts[hi - 1] + count[hi - 1])
        pieces = -(-count[lo:hi] // LANE)
        first = np.cumsum(pieces) - pieces
        cuts = np.repeat(starts[lo:hi] - a, pieces) + LANE * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
        ones = np.empty((len(cuts), 8), np.uint64)
        for at in range(a, b, 2 * WORDS):  # a long last line: a part of its pieces at a time
            own = slice(int(np.searchsorted(cuts, at - a)), int(np.searchsorted(cuts, at - a + 2 * WORDS)))
            end = int(cuts[own.stop]) + a if own.stop < len(cuts) else b
            if own.stop > own.start:
                begin = int(cuts[own.start])
                octets = hashes[a + begin:end].view(np.uint8).reshape(-1, 8)
                for k in range(8):
                    ones[own, k] = np.add.reduceat(_LANES[octets[:, k]], cuts[own] - begin)
        ones = ones.view(np.uint8)
        if len(cuts) > hi - lo:
            ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
        most = 2 * ones.astype(np.int64) > count[lo:hi, None]
        out[lo:hi] = np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()
        lo = hi
    return out


def parities(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """MAP longs of bits, each the parity of how many words of a line fall on
    it.  An edit changes two bits at most, so two lines differ in no more than
    twice their distance."""
    place = (hashes >> np.uint64(40)) % np.uint64(64 * MAP)
    bit, own = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6)
    return [np.bitwise_xor.reduceat(np.where(own == np.uint64(k), bit, np.uint64(0)), starts) for k in range(MAP)]


SIGNED = ("doc_id bigint, doc bigint, line int, h1 bigint, h2 bigint, sim bigint, " + ", ".join(f"m{k} bigint" for k in range(MAP)) + ", code binary")


def _signed(ids: list, docs: list, numbers: list, lines: list[str]):
    hashes, bounds = words(pa.array(lines, pa.large_string()), ALNUM)
    kept = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(kept):
        return None
    starts, count = bounds[kept], bounds[kept + 1] - bounds[kept]
    symbols = (hashes % np.uint64(SYMBOLS) + np.uint64(FIRST)).astype(">u2")
    offsets = np.append(2 * starts, 2 * len(hashes)).astype(np.int32)
    code = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(symbols.tobytes())])
    take = lambda x, kind: pa.array([x[i] for i in kept], kind)
    signed = [pa.array(x.view(np.int64)) for x in (line_hash(hashes, starts, count, 0), line_hash(hashes, starts, count, 1), simhash(hashes, starts, count), *parities(symbols.astype(np.uint64) * np.uint64(_ODD[0]), starts))]
    return pa.RecordBatch.from_arrays([take(ids, pa.int64()), take(docs, pa.int64()), take(numbers, pa.int32()), *signed, code],
                                      ["doc_id", "doc", "line", "h1", "h2", "sim", *[f"m{k}" for k in range(MAP)], "code"])


def signed(batches):
    """(doc_id, doc, text) to the signature of every line with words."""
    for batch in batches:
        ids, docs, numbers, lines, chars = [], [], [], [], 0
        for doc_id, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = normal(text).split("\n")
            for i, line in enumerate(own):
                ids.append(doc_id)
                docs.append(doc)
                numbers.append(i)
                lines.append(line)
                chars += len(line)
                if chars >= CHARS:
                    if (out := _signed(ids, docs, numbers, lines)) is not None:
                        yield out
                    ids, docs, numbers, lines, chars = [], [], [], [], 0
        if lines and (out := _signed(ids, docs, numbers, lines)) is not None:
            yield out


def _codes(column) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, bounds) of a column of codes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, ">u2", count=(int(at[-1]) - int(at[0])) // 2, offset=int(at[0])).astype(np.uint16)
    return flat, (at - at[0]) // 2


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of an adjacent word pair among PAIRS counters."""
    return (mix((a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _pair_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions of the words that begin an adjacent pair: all but each line's last."""
    inner = np.ones(n, bool)
    inner[bounds[1:][np.diff(bounds) > 0] - 1] = False
    return np.flatnonzero(inner)


def frequencies(batches):
    """Codes to (part, n): the task's counts of TABLE characters and PAIRS
    hashed word pairs, CHUNK of them a row."""
    total, held, size = np.zeros(TABLE + PAIRS, np.int64), [], 0

    def add():
        for x in held:
            total[:TABLE] += np.bincount(x[0], minlength=TABLE)
        if held:
            total[TABLE:] += np.bincount(np.concatenate([x[1] for x in held]), minlength=PAIRS)

    for batch in batches:
        if not batch.num_rows:
            continue
        symbols, bounds = _codes(batch.column(0))
        at = _pair_starts(bounds, len(symbols))
        held.append((symbols, _bucket(symbols[at], symbols[at + 1])))
        size += len(symbols)
        if size >= 1 << 20:
            add()
            held, size = [], 0
    add()
    parts = total.reshape(-1, CHUNK)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].astype("<u8").tobytes() for i in some], pa.binary())], ["part", "n"])


def summed(batches):
    """(part, n) added up for each part of the task."""
    total = {}
    for batch in batches:
        for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(n, "<u8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["part", "n"])


def classes(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character how often it stands in the lines, in quarters of a
    power of two, and for each place of a pair how far its count lies above
    twice the mean, in halves of one; 0 for most."""
    words_, pairs = total[:TABLE], total[TABLE:]
    common = np.where(words_ > 0, np.minimum(255, 1 + 4 * np.log2(np.maximum(words_, 1))), 0).astype(np.uint64)
    beyond = np.ceil(2 * np.log2(np.maximum(pairs, 1) / (2 * pairs.mean() + 4)))
    return common, np.clip(beyond, 0, HEAVIEST).astype(np.uint64)


def most_edits(n: np.ndarray, least: float) -> np.ndarray:
    return np.floor(n * (1 - least) + 1e-9).astype(np.int64)


def promised(n: np.ndarray) -> np.ndarray:
    """Keys that a line of n words is sure to share with a similar one no shorter;
    long lines share a few rare pairs by chance."""
    return np.maximum(COMMON, n // PER_COMMON)


def rarest_pairs(classes: np.ndarray, least: float, heavy: np.ndarray | None = None, common=lambda n: 2, numbered: bool = False):
    """(id, code) to (key, id, n): the rarest adjacent word pairs of each line of n words, by
    the classes of the pairs' own counts where those stand out (``heavy``), then
    by the frequency classes of their words.  A passage of rare words that many
    lines hold would fill their keys if the words alone decided.

    A line of n words has as many pairs as are needed to share c = ``common(n)`` with every
    similar line no shorter, c + 2 d with d the edits possible at n + 1 words: an edit
    destroys two pairs at most, and a longer partner has as many insertions as
    it is longer, each of which destroys one.  The id's lowest bit tells that
    the line has too few different pairs to promise c common ones.  Any order
    of all pairs keeps this promise.  With ``numbered`` a line's second, third ...
    occurrence of a pair are pairs of their own: each edit still destroys two at
    most, and only short lines have too few."""
    def pairs(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            symbols, bounds = _codes(batch.column(1))
            n = np.diff(bounds)
            need = np.where(most_edits(n + 1, least) > 0, common(n) + 2 * most_edits(n + 1, least), 0)
            line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            at = _pair_starts(bounds, len(symbols))
            if not len(at):
                continue
            a, b = symbols[at], symbols[at + 1]
            order = classes[a] + classes[b]
            if heavy is not None:
                order = order + (heavy[_bucket(a, b)] << np.uint64(9))
            key = (order << np.uint64(32)) | (a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)
            packed = (line[at] << np.uint64(47)) | key
            packed = np.sort(packed) if numbered else np.unique(packed)
            line = (packed >> np.uint64(47)).astype(np.int64)
            first = np.searchsorted(line, np.arange(len(n)))
            kept = np.arange(len(packed)) - first[line] < need[line]
            weak = np.bincount(line, minlength=len(n)) < need
            line, key = line[kept], packed & np.uint64((1 << 47) - 1)
            if numbered:  # beyond 2^16 occurrences numbers repeat, which only adds candidates
                at = np.arange(len(packed))
                number = at - np.maximum.accumulate(np.where(np.r_[True, packed[1:] != packed[:-1]], at, 0))
                key |= (number.astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(47)
            yield pa.RecordBatch.from_arrays([pa.array(key[kept].astype(np.int64)), pa.array(ids[line] * 2 + weak[line]),
                                              pa.array(n[line].astype(np.int32))], ["key", "id", "n"])
    return pairs


DEALT = "part int, n int, rows binary"


def _message(part: list[int], n: list[int], rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(rows, pa.binary())], ["part", "n", "rows"])


def _deal(columns: list[np.ndarray], by: int, parts: int) -> pa.RecordBatch:
    """One row for each part: the part's rows, column by column.  The part of a
    row follows from its first ``by`` columns."""
    spot = mix(columns[0].view(np.uint64))
    for c in columns[1:by]:
        spot = mix(spot + c.view(np.uint64))
    part = (spot >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    n = np.bincount(part.astype(np.int64), minlength=parts)
    ends, columns = np.cumsum(n), [c[order] for c in columns]
    some = np.flatnonzero(n).tolist()
    return _message(some, n[some].tolist(), [b"".join(c[ends[i] - n[i]:ends[i]].tobytes() for c in columns) for i in some])


def dealt(kinds: tuple[str, ...], by: int, parts: int, made=iter):
    """The rows that ``made`` gives for the batches, many of a part in one
    message, so that Spark moves and reads messages and not rows."""
    def deal(batches):
        held, size = [], 0
        whole = lambda: [np.concatenate([h[i] for h in held]) for i in range(len(kinds))]
        for batch in made(batches):
            held.append([c.to_numpy(zero_copy_only=False).astype(k) for c, k in zip(batch.columns, kinds)])
            size += batch.num_rows
            if size >= HELD:
                yield _deal(whole(), by, parts)
                held, size = [], 0
        if size:
            yield _deal(whole(), by, parts)
    return deal


def _read(batches, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The rows of all messages, by column."""
    found, width = [[np.zeros(0, k)] for k in kinds], sum(np.dtype(k).itemsize for k in kinds)
    for batch in batches:
        for n, rows in zip(batch.column(1).to_pylist(), batch.column(2)):
            rows, at = rows.as_buffer(), 0
            if len(rows) != n * width:
                raise ValueError(f"a message of {n} rows has {len(rows)} bytes")
            for k, out in zip(kinds, found):
                out.append(np.frombuffer(rows, k, n, at))
                at += n * out[-1].itemsize
    return [np.concatenate(x) for x in found]


def block_keys(blocks: int, paired: int):
    """(sim, id) to one (key, id) for each choice of ``paired`` of the SimHash's blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen) for chosen in combinations(range(blocks), paired)]

    def keys(batches):
        for batch in batches:
            sim, ids = (c.to_numpy() for c in batch.columns)
            for i, mask in enumerate(masks):
                key = mix(mix(sim.view(np.uint64) & np.uint64(mask)) + np.uint64(i))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], ["key", "id"])
    return keys


def starred(batches):
    """Dealt (key, id) to the pairs (a, b) of every line with the smallest and
    the largest line of its keys; a pair may come several times."""
    key, ids = _read(batches, BLOCKED)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    if not len(order):
        return
    key, ids = key[order], ids[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    members = np.diff(np.r_[first, len(key)])
    for ends in (np.minimum, np.maximum):
        hub = np.repeat(ends.reduceat(ids, first), members)
        a, b = np.minimum(ids, hub), np.maximum(ids, hub)
        yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], ["a", "b"])


def _longest(n: np.ndarray, least: float) -> np.ndarray:
    """The words of the longest line that may be similar to one of n words."""
    out = (n / least).astype(np.int64) + 2
    while (far := out - most_edits(out, least) > n).any():
        out -= far
    return out


def _shared(key: np.ndarray, ids: np.ndarray, n: np.ndarray, least: float):
    """The rows of keys with a partner of fitting length, sorted by key and
    length: (key's number, key, id, n, how many rows behind fit)."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    number = np.cumsum(np.r_[False, key[order[1:]] != key[order[:-1]]]) if len(order) else order
    cell = number << 32 | n[order]
    by = np.argsort(cell)
    order, cell = order[by], cell[by]
    longest = np.minimum(_longest(n[order].astype(np.int64), least), (1 << 31) - 1)
    behind = np.searchsorted(cell, cell >> 32 << 32 | longest, side="right") - np.arange(len(cell)) - 1
    fits = np.flatnonzero((behind > 0) | np.r_[False, behind[:-1] > 0][:len(behind)])  # a row that fits any before it fits the one before it
    order = order[fits]
    return cell[fits] >> 32, key[order], ids[order], n[order], behind[fits]


def promises(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Keys that two similar lines of x and y words share at least."""
    longer = np.maximum(x, y).astype(np.int64)
    return np.minimum(promised(np.minimum(x, y)), longer - 1 - 2 * most_edits(longer, least))


def paired(least: float, parts: int):
    """Dealt (key, id, n) to dealt (a, b, promised): the pairs of lines of
    fitting length that share a key, once for each key.  A key that would give
    more than CROWD pairs for each of its rows is crowded: its rows (key, id,
    smallest id, members) come as messages of part -1."""
    def pairs(batches):
        number, key, ids, n, behind = _shared(*_read(batches, KEYS), least)
        if not len(number):
            return
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        members = np.diff(np.r_[first, len(number)])
        crowd = np.repeat(np.add.reduceat(behind, first) > CROWD * members, members)
        low, members = np.repeat(np.minimum.reduceat(ids, first), members), np.repeat(members, members)
        at = np.flatnonzero(crowd)
        for lo in range(0, len(at), MESSAGE):
            own = at[lo:lo + MESSAGE]
            columns = (key[own], ids[own], low[own], members[own])
            yield _message([-1], [len(own)], [b"".join(c.astype(k).tobytes() for c, k in zip(columns, CROWDED))])
        behind = np.where(crowd, 0, behind)
        ends = np.cumsum(behind)
        lo = 0
        while lo < len(behind):  # about HELD pairs at once
            done = int(ends[lo] - behind[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, done + HELD, side="right")))
            x = np.repeat(np.arange(lo, hi), behind[lo:hi])
            y = x + 1 + np.arange(len(x)) - (ends - behind)[x] + done
            x, y = x[ids[x] != ids[y]], y[ids[x] != ids[y]]
            if len(x):
                yield _deal([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), promises(n[x], n[y], least).astype(np.int32)], 2, parts)
            lo = hi
    return pairs


def crowded(batches):
    """Messages of crowded keys to (key, id, low, members)."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _read([batch.slice(i, 1)], CROWDED)], ["key", "id", "low", "members"])


def counted(batches):
    """Dealt (a, b, promised) to the pairs (a, b) that come at least as often as promised."""
    a, b, least = _read(batches, MET)
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    first = first[np.diff(np.r_[first, len(a)]) >= least[first]]
    yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])


def keys_of(pairs, full: np.ndarray, which: bool):
    """Rows (key, id, n) of ``pairs``, the id without its lowest bit: those whose
    word pair's counter is in ``full``, or the others."""
    def rows(batches):
        for batch in pairs(batches):
            key, ids, n = (c.to_numpy() for c in batch.columns)
            kept = full[_bucket(key >> 16 & 0xFFFF, key & 0xFFFF)] == which if full.any() else np.full(len(key), not which)
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(ids[kept] >> 1), pa.array(n[kept])], ["key", "id", "n"])
    return rows


def bag_distances(x: np.ndarray, at: np.ndarray, y: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """For each pair of lines the larger number of words that one has beyond the
    other's, order aside: no more than their edit distance."""
    pair = lambda bounds: np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    cell = np.concatenate([(pair(at) << np.uint64(16)) | x, (pair(bt) << np.uint64(16)) | y])
    sign = np.concatenate([np.ones(len(x), np.int64), np.full(len(y), -1, np.int64)])
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    more = np.add.reduceat(sign[order], first) if len(first) else np.zeros(0, np.int64)
    own = (cell[first] >> np.uint64(16)).astype(np.int64)
    beyond = lambda v: np.bincount(own, weights=np.maximum(v, 0), minlength=len(at) - 1)
    return np.maximum(beyond(more), beyond(-more)).astype(np.int64)


def similar_pairs(least: float):
    """(a, b, ca, cb) to the (a, b) whose codes have an edit similarity of at least ``least``."""
    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, at), (y, bt) = _codes(batch.column(2)), _codes(batch.column(3))
            most = most_edits(np.maximum(np.diff(at), np.diff(bt)), least)
            kept = [i for i in np.flatnonzero(bag_distances(x, at, y, bt) <= most)
                    if edit_distance(x[at[i]:at[i + 1]].tolist(), y[bt[i]:bt[i + 1]].tolist()) <= most[i]]
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))
    return check

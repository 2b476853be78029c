"""Benchmark decontamination: a broadcast set of hashed test windows, a scan of
every document's words, exact verification of the hits, removal of spans or
documents.

Definition.  Words are runs of ASCII letters and digits and non-ASCII
characters, A-Z lower-cased.  A window is ``size`` consecutive words of an
item; an item of fewer words, but not none, is one window.  A document word
inside any occurrence of a window is hit.

Defined cases.  Null texts have no words and no windows.  Items without words
never occur.  An item with a null id counts under the empty id.  Repeated item
rows count once.  Repeated document rows each get their own result.  Empty
tables give empty results or no hits.  Columns other than those named are
passed through by the filters, whatever their names.

Size.  Items are collected in blocks of at most ``BLOCK_BYTES`` of text, each
block is broadcast on its own, and with more than one block the hits found per
block are united by row, so no benchmark is too large for a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexeval.llm.common import fresh, stage
from lexeval.llm.words import ALNUM, text_buffer, windows, words

WINDOW = 10
BLOCK_BYTES = 16 << 20
_BITS = 22

FOUND = "struct<n_words:bigint,spans:array<struct<lo:int,hi:int>>,items:array<string>>"


def _word_list(data, starts, ends) -> tuple:
    return tuple(data[s:e].tobytes().lower() for s, e in zip(starts, ends))


class Index:
    """Windows of one block of items: per window length the sorted hashes, a
    bit table over them, and the words and items of each window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        hashes, bounds, starts, ends = words(texts, ALNUM, spans=True)
        data, _ = text_buffer(texts)
        self.entries: dict[int, dict[int, dict[tuple, set]]] = {}
        for i, (item, _) in enumerate(items):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            length = min(size, hi - lo)
            if not length:
                continue
            grams = windows(hashes[lo:hi], length)
            for k, g in enumerate(grams.tolist()):
                w = _word_list(data, starts[lo + k:lo + k + length], ends[lo + k:lo + k + length])
                self.entries.setdefault(length, {}).setdefault(g, {}).setdefault(w, set()).add(item)
        self.bits = {}
        for length, known in self.entries.items():
            table = np.zeros(1 << _BITS, bool)
            table[np.fromiter(known, np.uint64, len(known)) >> np.uint64(64 - _BITS)] = True
            self.bits[length] = table

    def hits(self, column):
        """(word bounds, list of (first word, length, items)) of a text column;
        each hit has been compared word by word."""
        hashes, bounds, starts, ends = words(column, ALNUM, spans=True)
        data, _ = text_buffer(column)
        found = []
        for length, known in self.entries.items():
            grams = windows(hashes, length)
            for p in np.flatnonzero(self.bits[length][grams >> np.uint64(64 - _BITS)]):
                entry = known.get(int(grams[p]))
                if entry is None:
                    continue
                row = np.searchsorted(bounds, p, side="right") - 1
                if p + length > bounds[row + 1]:
                    continue
                items = entry.get(_word_list(data, starts[p:p + length], ends[p:p + length]))
                if items:
                    found.append((int(row), int(p), length, items))
        return bounds, starts, ends, found


def _spans(n: int, ranges) -> list[tuple[int, int]]:
    """Union of (first, length) word ranges as (lo, hi) pairs."""
    mark = np.zeros(n + 1, np.int64)
    for p, length in ranges:
        mark[p] += 1
        mark[p + length] -= 1
    on = np.cumsum(mark) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def _scanner(index: Index):
    @F.arrow_udf(FOUND)
    def scan(text: pa.Array) -> pa.Array:
        bounds, _, _, found = index.hits(text)
        by_row: dict[int, list] = {}
        for row, p, length, items in found:
            by_row.setdefault(row, []).append((p - int(bounds[row]), length, items))
        out = []
        for i in range(len(bounds) - 1):
            n, own = int(bounds[i + 1] - bounds[i]), by_row.get(i, ())
            out.append({"n_words": n, "spans": [{"lo": a, "hi": b} for a, b in _spans(n, [x[:2] for x in own])] if own else [],
                        "items": sorted(set().union(*(x[2] for x in own))) if own else []})
        return pa.array(out, pa.struct([("n_words", pa.int64()),
                                        ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                                        ("items", pa.list_(pa.string()))]))
    return scan


def _indexes(benchmark: DataFrame, size: int):
    """One index per block of at most about BLOCK_BYTES; only one block is on
    the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield blocks, Index([tuple(r) for r in part.distinct().collect()], size)


def scan(docs: DataFrame, benchmark: DataFrame, found: str, size: int = WINDOW) -> DataFrame:
    """``docs`` with a column ``found``: the number of words, the hit word
    ranges and the items that occur."""
    text = F.col("text").cast("string")
    parts, staged, row = [], None, fresh(docs, "row")
    for blocks, index in _indexes(benchmark, size):
        if blocks == 1:
            return docs.withColumn(found, _scanner(index)(text))
        if staged is None:  # row numbers must not change between the blocks
            staged = stage(docs.withColumn(row, F.monotonically_increasing_id()), "scan")
        part = staged.select(row, _scanner(index)(text).alias(found))
        parts.append(stage(part, "hits"))
    united = parts[0]
    for p in parts[1:]:
        united = united.union(p)
    united = united.groupBy(row).agg(F.struct(
        F.max(f"{found}.n_words").alias("n_words"), F.flatten(F.collect_list(f"{found}.spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list(f"{found}.items"))).alias("items")).alias(found))
    return staged.join(united, row).drop(row)


def covered(spans: Column) -> Column:
    """Number of words in the union of (lo, hi) ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.sort_array(spans), start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["hi"]).alias("end")), lambda a: a["n"])


def drop_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs."""
    found = fresh(docs, "found")
    return scan(docs, benchmark, found, size).where(F.size(F.col(found)["spans"]) == 0).drop(found)


def _cutter(index: Index):
    @F.arrow_udf("string")
    def cut(text: pa.Array) -> pa.Array:
        out = text.to_pylist()
        todo = list(range(len(out)))
        while todo:  # what moves together may form a window again
            column = pa.array([out[i] for i in todo], pa.large_string())
            bounds, starts, ends, found = index.hits(column)
            data, _ = text_buffer(column)
            ranges: dict[int, list] = {}
            for row, p, length, _ in found:
                ranges.setdefault(row, []).append((p - int(bounds[row]), length))
            offsets = text_buffer(column)[1]
            again = []
            for row, own in ranges.items():
                at, pieces, first = int(offsets[row]), [], int(bounds[row])
                for a, b in _spans(int(bounds[row + 1]) - first, own):
                    pieces.append(data[at:starts[first + a]].tobytes())
                    at = int(ends[first + b - 1])
                pieces.append(data[at:offsets[row + 1]].tobytes())
                out[todo[row]] = b"".join(pieces).decode("utf-8")
                again.append(todo[row])
            todo = again
        return pa.array(out, pa.string())
    return cut


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with every occurrence of a window cut out of ``text``, until
    none is left; other texts stay as they are."""
    text = F.col("text").cast("string")
    for blocks, index in _indexes(benchmark, size):
        docs = docs.withColumn("text", _cutter(index)(text))
        if blocks > 1:
            docs = stage(docs, "cut")
    return docs

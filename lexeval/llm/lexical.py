"""Ranked lexical search over an index of geometrically blocked posting lists.

Terms are the runs of ASCII letters and digits and non-ASCII characters, A-Z
lower-cased.  A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), a
document's m is 10 + ((90 n N) div L), and the document's impact for a term it
holds tf times is w * ((10^9 tf) div (1000 tf + 8 m)); N, L, n, df as in
:class:`Stats`.  A document's score for an item is the sum of its impacts over
the item's distinct terms.  Each item gets its ``k`` best documents with a score
above 0, equal scores by ascending doc_id.

Method: per-term geometric blocking.  The documents are kept in segments of at
most ``SEGMENT`` documents and ``POSTINGS`` postings.  In a segment, the posting
list of each term is clustered by document similarity: pivots are drawn from
the list by hash and each of its documents goes to the pivot with the largest
dot product, on random projections of the impact vectors.  Each cluster is a
block with a summary, the coordinatewise maximum of its documents' impacts over
the terms that occur beside the list's term in some item.  For an item, the
lists of its terms are visited from the heaviest term on.  A list is left out
with all later ones if even the largest impacts of the remaining terms together
stay below the item's threshold; a block is skipped if its summary's sum over
the item's terms does.  Documents of the other blocks are scored in full.  Only
scores below the threshold are ever skipped, so results are exact.

Thresholds start from real scores: before the index is built, every segment
scores for each item a few documents with the largest impacts of its heaviest
terms, and the item's k-th best score of these over all segments is a lower
bound.  Lists that no item can need at that bound are not built.

Size.  A segment is the largest thing a task holds, so a term of any document
frequency is split over the segments.  Items are taken in batches of at most
``BATCH_BYTES`` of text: the terms, thresholds and weights of a batch are what
is sent to the tasks.  The index is a table, written once a batch.

Defined cases.  Null texts have no terms, do not count in N and are never
found.  Items without terms find nothing; equal items (id and text) count once.
Repeated rows are documents of their own.  Null ids rank before all others.
Very long texts are split in pieces between terms.  Empty tables give an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexeval.llm.common import stage
from lexeval.llm.divergence import pieces

K = 10
SEGMENT, POSTINGS = 8192, 2_000_000
#: Documents per block on average, and dimensions of the projections that clusters go by.
BLOCK, SKETCH = 32, 64
BATCH_BYTES = 1 << 20
#: Heaviest terms of an item, and documents of each, that the first thresholds come from.
PRIME_TERMS, PRIME_DOCS = 6, 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_CUT = re.compile(rb"[^0-9A-Za-z\x80-\xFF]")


def terms(text: str | None) -> Counter:
    out = Counter()
    for piece in pieces((text or "").encode("utf-8"), _CUT):
        out.update(piece.translate(_FOLD).split())
    return out


@dataclass
class Queries:
    """A batch of items: ids, the vocabulary and the term numbers of each."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]


@dataclass
class Stats:
    """N documents with a term, L terms in all, df and weight by term number."""

    n: int
    length: int
    df: np.ndarray
    weight: np.ndarray


def _queries(rows) -> Queries:
    vocabulary, ids, own = {}, [], []
    for item, text in rows:
        ids.append(item)
        own.append(np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in terms(text)), np.int64))
    return Queries(ids, vocabulary, own)


def batches(items: DataFrame, limit: int = BATCH_BYTES):
    """The items in batches of at most about ``limit`` bytes of text."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-int(total) // limit))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield _queries(part.orderBy("item_id", "text").collect())


VECTOR = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: all of them are
    counted in n, those of the batch are listed."""
    known = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def read(found):
        number = known.value
        for batch in found:
            ids, n, size, own, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = terms(text)
                if not counts:
                    continue
                hit = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                ids.append(doc)
                n.append(counts.total())
                size.append(size[-1] + len(hit))
                own += [t for t, _ in hit]
                tfs += [c for _, c in hit]
            at = pa.array(size, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(own, pa.int32())),
                                              pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, VECTOR)


def statistics(found: DataFrame, queries: Queries) -> Stats:
    one = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(queries.vocabulary), np.int64)
    for term, count in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the batch's terms
        df[term] = count
    weight = np.array([math.floor(1000 * math.log((2 * one[0] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    return Stats(one[0], one[1], df, weight)


class Segment:
    """Documents with their impacts as a sparse matrix by rows; terms ascend
    within a row."""

    def __init__(self, ids: np.ndarray, valid: np.ndarray, start: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        self.ids, self.valid, self.start, self.term, self.impact, self.size = ids, valid, start, term, impact, size
        self.row = np.repeat(np.arange(len(ids)), np.diff(start))
        order = np.argsort(term, kind="stable")
        self.by_term = order
        self.list_at = np.searchsorted(term[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, term, impact)

    def posting(self, t: int):
        """(documents, impacts) of a term's list."""
        at = self.by_term[self.list_at[t]:self.list_at[t + 1]]
        return self.row[at], self.impact[at]

    def entries(self, docs: np.ndarray):
        """(position in ``docs``, place of the entry) of all entries of some documents."""
        n = self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(np.arange(len(docs)), n), np.arange(total) + np.repeat(self.start[docs] - ends + n, n)

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Sum of the impacts over the terms marked in ``asked``."""
        at, place = self.entries(docs)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, at, self.impact[place] * asked[self.term[place]])
        return out


def _impacts(n: np.ndarray, tf: np.ndarray, row: np.ndarray, term: np.ndarray, stats: Stats) -> np.ndarray:
    m = 10 + (90 * n * stats.n) // max(stats.length, 1)
    return stats.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))


def _segments(found, stats: Stats):
    """Documents of a partition, gathered into segments; entries of weight 0 are left out."""
    def made(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        lists, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row, term = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        impact = _impacts(table.column("n").to_numpy(), tfs.flatten().to_numpy(zero_copy_only=False), row, term, stats)
        keep = impact > 0
        start = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(size)))])
        ids = table.column("doc_id").combine_chunks()
        return Segment(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                       start, term[keep], impact[keep], len(stats.weight))

    parts, docs, postings = [], 0, 0
    for batch in found:
        at = 0
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        while at < batch.num_rows:  # as many rows as the segment still takes, one at least
            done = int(ends[at - 1]) if at else 0
            fits = int(np.searchsorted(ends, done + POSTINGS - postings, side="right")) - at
            take = min(batch.num_rows - at, SEGMENT - docs, max(fits, 0 if parts else 1))
            if take > 0:
                parts.append(batch.slice(at, take))
                at, docs = at + take, docs + take
                postings += int(ends[at - 1]) - done
            if at < batch.num_rows or docs >= SEGMENT or postings >= POSTINGS:
                yield made(parts)
                parts, docs, postings = [], 0, 0
    if parts:
        yield made(parts)


def _order(own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """An item's terms of some weight, the heaviest first."""
    own = own[weight[own] > 0]
    return own[np.lexsort((own, -weight[own]))]


def _top(score: np.ndarray, doc: np.ndarray, k: int, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((segment.ids[doc], segment.valid[doc], -score))[:k]
    return score[best], doc[best]


def thresholds(found: DataFrame, queries: Queries, stats: Stats, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For each item a lower bound of its k-th best score, 1 at least, and for
    each term its largest impact."""
    shared = found.sparkSession.sparkContext.broadcast((queries.terms, stats))

    def prime(parts):
        own, stats = shared.value
        for segment in _segments(parts, stats):
            item, score = [], []
            for q, ts in enumerate(own):
                first = [t for t in _order(ts, stats.weight) if segment.most[t]][:PRIME_TERMS]
                docs = []
                for t in first:
                    rows, impact = segment.posting(t)
                    docs.append(rows if len(rows) <= PRIME_DOCS else rows[np.argpartition(-impact, PRIME_DOCS)[:PRIME_DOCS]])
                if not docs:
                    continue
                asked = np.zeros(segment.size, bool)
                asked[ts] = True
                got = np.sort(segment.scores(np.unique(np.concatenate(docs)), asked))[::-1][:k]
                item += [q] * len(got)
                score += got.tolist()
            held = np.flatnonzero(segment.most)
            yield pa.RecordBatch.from_arrays([
                pa.array(["item"] * len(item) + ["term"] * len(held), pa.string()), pa.array([*item, *held.tolist()], pa.int32()),
                pa.array([*score, *segment.most[held].tolist()], pa.int64())], ["kind", "number", "value"])

    seen = stage(found.mapInArrow(prime, "kind string, number int, value bigint"), "prime")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("value")))
    floor = np.ones(len(queries.terms), np.int64)
    items = seen.where("kind = 'item'").withColumn("rank", rank).where(F.col("rank") <= k)
    for q, value, n in items.groupBy("number").agg(F.min("value"), F.count(F.lit(1))).collect():  # at most a row an item
        floor[q] = max(1, value) if n == k else 1
    most = np.zeros(len(stats.weight), np.int64)
    for t, value in seen.where("kind = 'term'").groupBy("number").agg(F.max("value")).collect():  # at most a row a term
        most[t] = value
    return floor, most


def needed(queries: Queries, stats: Stats, floor: np.ndarray, most: np.ndarray) -> dict[int, np.ndarray]:
    """Term -> coordinates of its summaries: the terms beside it in the items
    that may have to visit its list."""
    beside: dict[int, list] = {}
    for q, ts in enumerate(queries.terms):
        own = _order(ts, stats.weight)
        rest = np.cumsum(most[own][::-1])[::-1]
        for t in own[rest >= floor[q]]:
            beside.setdefault(int(t), []).append(own)
    return {t: np.unique(np.concatenate(x)) for t, x in beside.items()}


INDEX = ("ids array<bigint>, start array<int>, term array<int>, impact array<bigint>, block_term array<int>, block_at array<int>, "
         "block_docs array<int>, sum_at array<int>, sum_term array<int>, sum_most array<bigint>")


def cluster(sketch: np.ndarray, per_block: int = BLOCK) -> np.ndarray:
    """Block number of each document of a list: that of the pivot with the
    largest dot product.  Every n-th document is a pivot; documents come in no
    order of content."""
    n = -(-len(sketch) // per_block)
    if n == 1:
        return np.zeros(len(sketch), np.int64)
    pivots = sketch[(np.arange(n) * len(sketch)) // n]
    out = np.empty(len(sketch), np.int64)
    for lo in range(0, len(sketch), 4096):
        out[lo:lo + 4096] = np.argmax(sketch[lo:lo + 4096] @ pivots.T, axis=1)
    return np.unique(out, return_inverse=True)[1]


def sketches(segment: Segment) -> np.ndarray:
    """Random projections of the impact vectors, of unit length."""
    directions = np.random.default_rng(13).standard_normal((segment.size, SKETCH)).astype(np.float32)
    out = np.zeros((len(segment.ids), SKETCH), np.float32)
    for lo in range(0, len(segment.term), 1 << 18):  # rows ascend, so pieces add up
        hi = lo + (1 << 18)
        rows = segment.row[lo:hi]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] += np.add.reduceat(directions[segment.term[lo:hi]] * segment.impact[lo:hi, None].astype(np.float32), first, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def blocks(segment: Segment, lists: dict[int, np.ndarray]):
    """The lists of a segment in blocks: (term, documents, summary terms, summary maxima) of each."""
    sketch = sketches(segment)
    local = np.full(segment.size, -1, np.int64)
    for t, beside in lists.items():
        docs, _ = segment.posting(t)
        if not len(docs):
            continue
        own = cluster(sketch[docs])
        local[beside] = np.arange(len(beside))
        at, place = segment.entries(docs)
        column = local[segment.term[place]]
        inside = column >= 0
        width = len(beside)
        # numbered by the coordinates that occur, so that a hot list costs its entries and not a full matrix
        cell, back = np.unique(own[at[inside]] * width + column[inside], return_inverse=True)
        most = np.zeros(len(cell), np.int64)
        np.maximum.at(most, back, segment.impact[place[inside]])
        local[beside] = -1
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(own.max() + 2))
        edge = np.searchsorted(cell // width, np.arange(own.max() + 2))
        for b in range(int(own.max()) + 1):
            yield t, docs[order[cut[b]:cut[b + 1]]], beside[cell[edge[b]:edge[b + 1]] % width], most[edge[b]:edge[b + 1]]


def build_index(found: DataFrame, stats: Stats, lists: dict[int, np.ndarray]) -> DataFrame:
    """One row a segment: the impact vectors and the blocks with their summaries."""
    shared = found.sparkSession.sparkContext.broadcast((stats, lists))

    def build(parts):
        stats, lists = shared.value
        many = lambda xs, kind: pa.array([np.concatenate(xs) if xs else np.zeros(0, np.int64)], pa.list_(kind))
        ends = lambda xs: pa.array([np.cumsum([0, *map(len, xs)])], pa.list_(pa.int32()))
        for segment in _segments(parts, stats):
            term, docs, coordinate, most = [], [], [], []
            for t, d, c, m in blocks(segment, lists):
                term.append(t)
                docs.append(d)
                coordinate.append(c)
                most.append(m)
            ids = pa.array(segment.ids, pa.int64(), mask=~segment.valid)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([segment.start], pa.list_(pa.int32())),
                pa.array([segment.term], pa.list_(pa.int32())), pa.array([segment.impact], pa.list_(pa.int64())),
                pa.array([np.array(term, np.int64)], pa.list_(pa.int32())), ends(docs), many(docs, pa.int32()), ends(coordinate),
                many(coordinate, pa.int32()), many(most, pa.int64())],
                ["ids", "start", "term", "impact", "block_term", "block_at", "block_docs", "sum_at", "sum_term", "sum_most"])

    return found.where(F.size("terms") > 0).mapInArrow(build, INDEX)


class Index:
    """A segment read back from its row."""

    def __init__(self, row, size: int):
        get = lambda name: row[name].values.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = row["ids"].values
        self.segment = Segment(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                               get("start"), get("term"), get("impact"), size)
        self.block_term, self.block_at, self.block_docs = get("block_term"), get("block_at"), get("block_docs")
        self.sum_at, self.sum_term, self.sum_most = get("sum_at"), get("sum_term"), get("sum_most")
        edge = np.flatnonzero(np.r_[True, self.block_term[1:] != self.block_term[:-1]]) if len(self.block_term) else np.zeros(0, np.int64)
        self.list = {int(self.block_term[a]): (int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(self.block_term)])}

    def bounds(self, t: int, asked: np.ndarray) -> tuple[int, np.ndarray]:
        """First block of a term's list, and each block's summary over the asked terms."""
        lo, hi = self.list[t]
        at = self.sum_at[lo:hi + 1]
        value = self.sum_most[at[0]:at[-1]] * asked[self.sum_term[at[0]:at[-1]]]
        return lo, np.add.reduceat(value, at[:-1] - at[0])

    def search(self, own: np.ndarray, weight: np.ndarray, floor: int, k: int, seen=None):
        """(scores, documents) of the segment's best for one item, none below
        ``floor``.  ``seen`` counts [lists, lists left out, blocks, blocks skipped, documents scored]."""
        segment = self.segment
        asked = np.zeros(segment.size, bool)
        asked[own] = True
        order = _order(own, weight)
        order = order[segment.most[order] > 0]
        rest = np.cumsum(segment.most[order][::-1])[::-1]
        score, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = np.zeros(len(segment.ids), bool)
        for i, t in enumerate(order):
            if rest[i] < floor:
                if seen is not None:
                    seen[:2] += len(order) - i
                break
            first, bound = self.bounds(int(t), asked)
            open_ = np.flatnonzero(bound >= floor)
            if seen is not None:
                seen += [1, 0, len(bound), len(bound) - len(open_), 0]
            if not len(open_):
                continue
            docs = np.concatenate([self.block_docs[self.block_at[first + b]:self.block_at[first + b + 1]] for b in open_])
            docs = docs[~done[docs]]
            if not len(docs):
                continue
            done[docs] = True
            got = segment.scores(docs, asked)
            if seen is not None:
                seen[4] += len(docs)
            good = got >= floor
            score, doc = _top(np.concatenate([score, got[good]]), np.concatenate([doc, docs[good]]), k, segment)
            if len(score) == k:
                floor = max(floor, int(score[-1]))
        return score, doc


def search(index: DataFrame, queries: Queries, stats: Stats, floor: np.ndarray, k: int = K) -> DataFrame:
    """(item, doc_id, score), items by number: at most k of each segment."""
    shared = index.sparkSession.sparkContext.broadcast((queries.terms, stats.weight, floor))

    def find(rows):
        own, weight, floor = shared.value
        for batch in rows:
            for i in range(batch.num_rows):
                held = Index({name: batch.column(name)[i] for name in batch.schema.names}, len(weight))
                item, ids, score = [], [], []
                for q, ts in enumerate(own):
                    s, d = held.search(ts, weight, int(floor[q]), k)
                    item += [q] * len(s)
                    score += s.tolist()
                    ids += [int(held.segment.ids[x]) if held.segment.valid[x] else None for x in d]
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())],
                                                 ["item", "doc_id", "score"])

    return index.mapInArrow(find, "item int, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of the best documents of each item."""
    spark, out = docs.sparkSession, None
    for queries in batches(items):
        found = stage(vectors(docs, queries), "vectors")
        stats = statistics(found, queries)
        floor, most = thresholds(found, queries, stats, k)
        index = stage(build_index(found, stats, needed(queries, stats, floor, most)), "blocks")
        names = spark.createDataFrame([(q, x) for q, x in enumerate(queries.ids)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = search(index, queries, stats, floor, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most a batch's items
        out = part if out is None else out.union(part)
    return out


def oracle_sql(k: int = K) -> str:
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
docs AS (SELECT rid, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM docs),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS HUGEINT) AS w
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
m AS (SELECT rid, doc_id, 10 + ((90 * n::HUGEINT * n_docs) // n_terms) AS m FROM docs, total),
item AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
score AS (
  SELECT item_id, rid, m.doc_id, sum(w * ((1000000000::HUGEINT * tf) // (1000 * tf + 8 * m))) AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (rid) GROUP BY item_id, rid, m.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {k}"""

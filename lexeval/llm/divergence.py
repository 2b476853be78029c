"""Source divergence audit: how far the word use of each source of a language
lies from every other source and from the language as a whole.

Terms are the runs of ASCII letters and non-ASCII characters of a text, A-Z
lower-cased.  Each language keeps the V terms that occur in at least ``least``
of its documents.  A group (a source of a language, or the whole language)
with ``count`` occurrences of a term and N of all kept terms gives it the share
p = 1 + floor(10^9 * (count + 5) / (N + 5 V)), in exact integers.  Part
``pair`` sums |p - q| over all kept terms for every two sources of a language;
part ``term`` lists, per group, the ``top`` terms with the largest p - q > 0
against the language among those the group has.

Method: in-mapper stripes.  Each task folds whole documents into hash stripes,
term -> (document frequency, count per source), and spills them when they hold
``CELLS`` cells.  Stripes of a (language, term) meet in one shuffle, are merged
cell by cell with Spark's spilling aggregation and written once.  From the
merged stripes, with the totals of their language beside them, tasks add up the
pair sums of many terms at a time and emit the terms' own differences.

Skew.  A frequent term or a hot source sends one stripe a task and spill.  A
hot language's terms are dealt out by hash, and the emitting step salts them
over ``SALTS`` partitions.  Its pair sums are kept for ``SOURCES`` sources
against all at a time; nothing else grows with the number of sources but the
result.

Defined cases.  Null text, language and source are empty strings.  Repeated
rows are documents of their own.  A group without terms has N = 0 and still
gets its rows; V = 0 gives pairs of value 0 and no terms.  Very long texts are
folded in pieces cut between terms.  An empty table gives an empty result.
Only text, lang and source are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexeval.llm.common import stage

LEAST, TOP = 30, 50
#: Cells (a term's document frequency or its count in one source) that a task holds before it spills.
CELLS = 1 << 20
#: Bytes of a text that are split at once, and stripes of one Arrow batch.
PIECE, BATCH = 1 << 22, 20_000
#: Partitions a language's terms are dealt over, and sources of one block of pair sums.
SALTS, SOURCES = 64, 256
#: Terms whose shares are held as one matrix.
ROWS = 256

#: Separators become blanks, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CUT = re.compile(rb"[^A-Za-z\x80-\xFF]")

STRIPE = "lang string, term string, cells array<struct<source:string,n:bigint>>"
_CELL = pa.struct([("source", pa.string()), ("n", pa.int64())])


def pieces(data: bytes, cut: re.Pattern, size: int = PIECE):
    """``data`` in pieces of about ``size`` bytes that end before a separator."""
    at = 0
    while len(data) - at > size:
        found = cut.search(data, at + size)
        if found is None:
            break
        yield data[at:found.start()]
        at = found.start()
    yield data[at:] if at else data


def _spill(stripes: dict):
    """The stripes as Arrow batches; the document frequency is the cell without a source."""
    rows = [(lang, term, cells) for lang, own in stripes.items() for term, cells in own.items()]
    for lo in range(0, len(rows), BATCH):
        part = rows[lo:lo + BATCH]
        offsets = np.cumsum([0] + [len(c) for *_, c in part])
        source = pa.array([s for *_, c in part for s in c], pa.string())
        n = pa.array([v for *_, c in part for v in c.values()], pa.int64())
        cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([source, n], fields=list(_CELL)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()),
                                          pa.array([r[1] for r in part], pa.binary()).cast(pa.string()), cells], ["lang", "term", "cells"])


def _folder(limit: int):
    def fold(batches):
        stripes, held = {}, 0
        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                counts = Counter()
                for piece in pieces(text.encode("utf-8"), _CUT):
                    counts.update(piece.translate(_FOLD).split())
                counts[b""] = 1  # no term: counts the documents of the source
                own = stripes.setdefault(lang, {})
                for term, n in counts.items():
                    cells = own.get(term)
                    if cells is None:
                        own[term] = {None: 1, source: n}
                        held += 2
                        continue
                    cells[None] += 1
                    if source in cells:
                        cells[source] += n
                    else:
                        cells[source] = n
                        held += 1
                if held >= limit:
                    yield from _spill(stripes)
                    stripes, held = {}, 0
        yield from _spill(stripes)
    return fold


def stripes(docs: DataFrame, limit: int = CELLS) -> DataFrame:
    """(lang, term, source, n) after the merge: the occurrences of each term in
    each source, and with a null source the documents that hold it.  The empty
    term counts the documents."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    spilled = rows.mapInArrow(_folder(limit), STRIPE).repartition("lang", "term")
    cells = spilled.select("lang", "term", F.explode("cells").alias("cell")).select("lang", "term", "cell.source", "cell.n")
    return cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))


def kept_stripes(docs: DataFrame, least: int = LEAST, limit: int = CELLS) -> DataFrame:
    """(lang, term, cells) of the kept terms and of the empty term."""
    merged = stripes(docs, limit).groupBy("lang", "term").agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("df"),
        F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n")))).alias("cells"))
    return merged.where((F.col("df") >= least) | (F.col("term") == "")).select("lang", "term", "cells")


def language_rows(kept: DataFrame) -> DataFrame:
    """(lang, v, groups): the number of kept terms and per source, in order, the
    occurrences of kept terms (``total``)."""
    cells = kept.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.source", "c.n")
    groups = cells.groupBy("lang", "source").agg(F.sum(F.when(F.col("term") != "", F.col("n")).otherwise(F.lit(0))).alias("total"))
    v = kept.groupBy("lang").agg(F.sum((F.col("term") != "").cast("long")).alias("v"))
    return groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")).join(v, "lang")


def shares(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 v)), by long division in base
    1000, so nothing overflows below 9 * 10^15 occurrences."""
    whole = np.maximum(total + 5 * v, 1)
    q, r = np.divmod(count + 5, whole)
    for _ in range(3):
        digit, r = np.divmod(r * 1000, whole)
        q = q * 1000 + digit
    return q + 1


EMITTED = "part string, lang string, source string, item string, value bigint"


def _emit(batches):
    """Stripes, sorted by language and block of sources, to partial pair sums
    and term differences."""
    key, sums, names, first = None, None, [], 0

    def flush():
        if key is None:
            return
        at, other = np.nonzero(sums)
        yield _emitted("pair", key[0], [names[first + i] for i in at], [names[j] for j in other], sums[at, other])

    for batch in batches:
        lang, block = batch.column("lang"), batch.column("block").to_numpy(zero_copy_only=False)
        change = np.flatnonzero(block[1:] != block[:-1]) + 1
        code = lang.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change = np.union1d(change, np.flatnonzero(code[1:] != code[:-1]) + 1)
        for lo, hi in zip([0, *change], [*change, len(block)]):
            run = batch.slice(lo, hi - lo)
            if (run.column("lang")[0].as_py(), int(block[lo])) != key:
                yield from flush()
                key = (run.column("lang")[0].as_py(), int(block[lo]))
                groups = run.column("groups")[0].as_py()
                names = [g["source"] for g in groups]
                total = np.array([g["total"] for g in groups], np.int64)
                v, known = run.column("v")[0].as_py(), pa.array(names, pa.string())
                first = key[1] * SOURCES
                last = min(first + SOURCES, len(names))
                sums = np.zeros((last - first, len(names)), np.int64)
            for at in range(0, hi - lo, ROWS):
                part = run.slice(at, ROWS)
                cells = part.column("cells")
                row, flat = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False)), cells.flatten()
                column = pc.index_in(flat.field("source"), value_set=known).to_numpy(zero_copy_only=False)
                count = np.zeros((len(cells), len(names)), np.int64)
                count[row, column] = flat.field("n").to_numpy(zero_copy_only=False)
                p = shares(count, total, v)
                q = shares(count.sum(1), total.sum(), v)
                for i in range(first, last):
                    sums[i - first] += np.abs(p - p[:, i:i + 1]).sum(0)
                more = p[:, first:last] - q[:, None]
                t, s = np.nonzero((more > 0) & (count[:, first:last] > 0))
                if len(t):
                    terms = part.column("term").take(pa.array(t))
                    yield _emitted("term", key[0], [names[first + i] for i in s], terms, more[t, s])
    yield from flush()


def _emitted(part, lang, source, item, value):
    n = len(value)
    item = item if isinstance(item, pa.Array) else pa.array(item, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array(source, pa.string()),
                                       item.cast(pa.string()), pa.array(value, pa.int64())], ["part", "lang", "source", "item", "value"])


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, limit: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module."""
    kept = stage(kept_stripes(docs, least, limit), "stripes")
    langs = stage(language_rows(kept), "languages")
    blocks = F.ceil(F.size("groups") / F.lit(SOURCES)).cast("int")
    dealt = langs.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    terms = kept.where("term <> ''").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    joined = terms.join(dealt, ["lang", "salt"]).select("lang", "term", "cells", "groups", "v",
                                                        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    emitted = stage(joined.sortWithinPartitions("lang", "block").mapInArrow(_emit, EMITTED), "divergences")

    order = lambda *by: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = emitted.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    names = F.transform("groups", lambda g: g["source"])
    pairs = (langs.select("lang", F.explode(names).alias("source"), names.alias("names"))
             .select("lang", "source", F.explode("names").alias("item")).where("source <> item")
             .join(found, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    best = emitted.where("part = 'term'").select("lang", "source", "part", "item", "value")
    best = best.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order())).unionByName(best)


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
occ AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT rid) AS df FROM occ GROUP BY ALL),
kept AS (SELECT lang, term FROM cnt GROUP BY lang, term HAVING sum(df) >= {least}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
full_counts AS (
  SELECT g.lang, g.source, kept.term, coalesce(cnt.c, 0) AS c
  FROM g JOIN kept ON g.lang = kept.lang
  LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
p AS (
  SELECT lang, source, term, c,
         1 + (1000000000 * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM full_counts JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000 * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM full_counts GROUP BY lang, term) JOIN v USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {top}"""

"""Fuzzy line deduplication.

A line's words are the runs of its lower-cased text without ASCII and common
other punctuation and white space; lines without words are left alone.  Lines
with equal word sequences are copies of one another and are one vertex from
here on.  Two different lines are linked if the edit similarity of their word
sequences, 1 - distance / longer length, reaches ``SIMILARITY``; each word
counts as one of 55,000 characters by its hash.  Of each connected group the
first occurrence stays, by (doc_id, line number); all others go.

Candidates.  First come the SimHashes: lines that share ``PAIRED`` of ``BLOCKS``
blocks meet the smallest and largest line of the block pair, and the verified
links give the first components.  What SimHashes cannot promise is closed by
the rarest word pairs.  An edit destroys at most two of the adjacent word pairs
of a line, so the c smallest pairs that two similar lines share, in any order
of all pairs, are among the first 2 d + c of both (d: edits possible at a line's
length, see ``linecodes.rarest_pairs``; c: ``linecodes.promised`` of the shorter).  The order is by the pairs' own
counts where these stand out, then by the frequencies of the two words, so
frequent phrases and passages are keys only of lines without others.
The pairs of a line are numbered where they repeat, so lines of few words said many
times promise as much as others.  Lines that share c keys and still lie in different
components are compared; fewer are enough where both are too short to promise as many.  No
link asks anything of the SimHashes, so none is lost by them.

Style.  Signatures, keys and the pairs of lines that share them are made in Arrow
batches (``linecodes``), the joins and components are Spark's.  The form in
DataFrame functions alone did not fit the limits (README).

Scale.  One shuffle moves the distinct lines as two bytes a word, one moves the
keys, packed in messages of many rows to parts of about ``PART`` keys.  There
keys of one line end, and so do rows without a line of fitting
length in their key; the others give their pairs, which meet in parts once more
and are counted.  Keys that would give more than ``linecodes.CROWD`` pairs for each
row are not paired there but go on as rows, and so do keys that may have more than
``GATHERED`` rows, which Spark's own shuffle brings together (the rows of one
SimHash block key always meet in one task, 16 bytes a row).  Of these, members
of a key of more than ``BUSY`` lines meet its smallest line first; what then still lies in several components meets
by the binary digits of the components' ranks within the key, so that no two
lines of a component are ever looked at together.  Frequencies of words and word
pairs are counters of a fixed number, whatever the size of the input.

Defined cases.  Null and empty texts have no lines.  Rows with the same doc_id
and text are one document: each of them gets the same lines.  Rows with the
same doc_id and different texts are different documents.  A null doc_id ranks
before all others.  Line numbers count from 0 over all ``\\n``-split lines.  An
empty table gives an empty result.  Only doc_id and text are read;
``dedup_lines`` passes all other columns through.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeval.llm import linecodes
from lexeval.llm.common import discard, fresh, let, release, stage
from lexeval.llm.components import components

BLOCKS, PAIRED = 4, 2
#: Members from which on a key is hot, and from which on its lines meet its smallest one first.
HOT, BUSY = 64, 16
#: Rows of crowded keys that are paired at once, or two a line where that is more, so that a turn's shuffles bound the disk.
TURN = 1 << 22
#: Keys that a task gathers, and fewer where there are few.
PART, LEAST_PART = 1 << 20, 1 << 14
#: Word pairs that may stand more often than this are keys of Spark's own shuffle, so that no task gathers them.
GATHERED = 1 << 20
#: Parity bits that travel with the keys.
PRINT = ("m0", "m1")
SIMILARITY = 0.8
#: Pairs up to this many (16 bytes each) are broadcast to pick their texts.
BROADCAST_PAIRS = 1_000_000
_PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF -⁯　-〃]+"


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), _PUNCTUATION), "")


def most_edits(longer: Column, least: float) -> Column:
    return F.floor(longer * (1 - least) + 1e-9).cast("int")


def promised(x: Column, y: Column, least: float) -> Column:
    """Keys that two similar lines of x and y words share at least: all the pairs
    that the edits leave where these are fewer than ``linecodes.promised``."""
    longer = F.greatest(x, y)
    own = F.greatest(F.lit(linecodes.COMMON), F.floor(F.least(x, y) / linecodes.PER_COMMON)).cast("int")
    return F.least(own, longer - 1 - 2 * most_edits(longer, least))


def counters(lines: DataFrame) -> np.ndarray:
    """How often words and hashed word pairs stand in the distinct lines.
    Counters of a fixed number are added up in
    tasks; 9 MB reach the driver, however long the input."""
    parts = lines.select("code").mapInArrow(linecodes.frequencies, "part int, n binary").repartition("part")
    total = np.zeros((linecodes.TABLE + linecodes.PAIRS) // linecodes.CHUNK * linecodes.CHUNK, np.int64).reshape(-1, linecodes.CHUNK)
    for part, n in parts.mapInArrow(linecodes.summed, "part int, n binary").collect():
        total[part] += np.frombuffer(n, "<u8").astype(np.int64)
    return total.ravel()


def _doc_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def signed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, line, h1, h2, sim, code) of every line with words: its
    words' 128-bit hash, their SimHash and their two-byte codes."""
    return _named(docs).select("doc_id", _doc_key().alias("doc"), "text").mapInArrow(linecodes.signed, linecodes.SIGNED)


def shared_keys(keys: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of ``keys(key, id, ...)`` whose key has two or more ids, with the
    key's smallest id and its number of rows: one exchange, and a lookup in the
    partition's keys.  With ``least``, keys of two rows whose lengths ``n`` do not
    allow the similarity go too."""
    dealt = keys.repartition("key")
    found = [F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("members")]
    if least is None:
        several = dealt.groupBy("key").agg(*found).where("low <> high")
    else:  # both branches read all columns of the rows: one that left n out would have an exchange of its own
        several = dealt.groupBy("key").agg(*found, F.min("n").alias("short"), F.max("n").alias("long"))
        fits = F.col("long") - F.col("short") <= most_edits(F.col("long"), least)
        several = several.where((F.col("low") != F.col("high")) & ((F.col("members") > 2) | fits)).drop("short", "long")
    return dealt.join(several.hint("shuffle_hash"), "key")


def fitting(rows: DataFrame, least: float) -> DataFrame:
    """The rows of ``rows(key, n, ...)`` whose length allows the similarity to
    another row of the key: if the next shorter and the next longer do not fit,
    none does.  Rows dealt by key are sorted where they lie."""
    order = Window.partitionBy("key").orderBy("n")
    fits = lambda less, more: F.coalesce(F.col(more) - F.col(less) <= most_edits(F.col(more), least), F.lit(False))
    beside = rows.withColumns({"below": F.lag("n").over(order), "above": F.lead("n").over(order)})
    return beside.where(fits("below", "n") | fits("n", "above")).drop("below", "above")


def cross_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, promised) for each key that two lines of ``rows(key, id, component, n,
    m0, m1, members)`` share, if they lie in different components and their
    lengths and half of their parity bits allow the similarity.  Keys of up to HOT rows are joined with themselves; in
    others, two components differ first in one binary digit of their ranks, and
    only there their lines meet."""
    own = ["id", "component", "n", *PRINT]
    side = lambda df, less: df.select(*[c for c in df.columns if c not in own], *[F.col(c).alias(less + c) for c in own])
    most = most_edits(F.greatest("x_n", "y_n"), least)
    # of pairs that share many keys, as lines around one passage do, most end here and not after the shuffle of all pairs
    apart = F.bit_count(F.col("x_m0").bitwiseXOR(F.col("y_m0"))) + F.bit_count(F.col("x_m1").bitwiseXOR(F.col("y_m1")))
    fits = (F.abs(F.col("x_n") - F.col("y_n")) <= most) & (apart <= 2 * most)
    out = [F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), promised(F.col("x_n"), F.col("y_n"), least).alias("promised")]
    cold = rows.where(F.col("members") <= HOT).drop("members")
    few = side(cold, "x_").join(side(cold, "y_"), "key").where((F.col("x_component") < F.col("y_component")) & fits)
    hot = rows.where(F.col("members") > HOT).drop("members")
    rank = hot.withColumn("rank", F.dense_rank().over(Window.partitionBy("key").orderBy("component")) - 1)
    most = rank.groupBy("key").agg(F.max("rank").alias("last")).where("last > 0")
    digits = F.length(F.bin("last")) - 1
    digit = rank.join(most, "key").select("key", *own, "rank", F.explode(F.sequence(F.lit(0), digits)).alias("digit"))
    digit = digit.withColumns({"above": F.expr("shiftright(rank, digit + 1)"), "bit": F.expr("shiftright(rank, digit) & 1")}).drop("rank")
    many = side(digit.where("bit = 0").drop("bit"), "x_").join(side(digit.where("bit = 1").drop("bit"), "y_"), ["key", "digit", "above"]).where(fits)
    return few.select(*out).union(many.select(*out))


def line_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, doc, line, keeper) of every occurrence of a line that goes;
    ``doc`` is the document's key, ``keeper`` the (doc_id, doc, line) that stays."""
    if least < 0.75:
        raise ValueError("below a similarity of 0.75 short lines need not share a word pair")
    spark = docs.sparkSession
    full = stage(signed_lines(docs), "signed")
    place, maps = F.struct("doc_id", "doc", "line"), [f"m{k}" for k in range(linecodes.MAP)]
    lines = full.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n"),
                                           *[F.any_value(c).alias(c) for c in (*maps, "code")])
    # the number of words stands beside the codes, so that who asks for it alone reads no codes
    lines = stage(lines.withColumns({"id": F.monotonically_increasing_id(), "words": (F.octet_length("code") / 2).cast("int")}), "distinct")
    seen = stage(full.select("doc_id", "doc", "line", "h1", "h2"), "lines")
    discard(full)
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar.  Lengths and parity bits
        rule most others out before texts are fetched."""
        def named(found: DataFrame) -> DataFrame:
            ids = found.select(F.explode_outer(F.array("a", "b")).alias("id")).distinct()
            return F.broadcast(ids) if found.count() <= BROADCAST_PAIRS else ids

        pairs = stage(pairs, "pairs")
        own = lines.join(named(pairs), "id", "left_semi")
        print_ = lambda c: own.select(F.col("id").alias(c), F.col("words").alias(f"{c}_n"),
                                      *[F.col(m).alias(f"{c}_{m}") for m in maps])
        most = most_edits(F.greatest("a_n", "b_n"), least)
        apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in maps[1:]), F.bit_count(F.col("a_m0").bitwiseXOR(F.col("b_m0"))))
        near = pairs.join(print_("a"), "a").join(print_("b"), "b").where((F.abs(F.col("a_n") - F.col("b_n")) <= most) & (apart <= 2 * most))
        near = stage(near.select("a", "b"), "near")
        release(spark)
        texts = lines.select("id", "code").join(named(near), "id", "left_semi")
        both = near.join(texts.select(F.col("id").alias("a"), F.col("code").alias("ca")), "a").join(
            texts.select(F.col("id").alias("b"), F.col("code").alias("cb")), "b")
        return both.select("a", "b", "ca", "cb").mapInArrow(linecodes.similar_pairs(least), "a bigint, b bigint")

    def stars(rows: DataFrame, hub: str) -> DataFrame:
        return rows.where(F.col("id") != F.col(hub)).select(F.least("id", hub).alias("a"), F.greatest("id", hub).alias("b")).distinct()

    def parts_of(rows: int) -> int:
        return 1 + max(rows // PART, min(spark.sparkContext.defaultParallelism, rows // LEAST_PART))

    many = lines.count()
    parts = parts_of(many * comb(BLOCKS, PAIRED))
    blocks = lines.select("sim", "id").mapInArrow(linecodes.dealt(linecodes.BLOCKED, 1, parts, linecodes.block_keys(BLOCKS, PAIRED)), linecodes.DEALT)
    blocks = blocks.repartitionById(parts, "part")
    links = stage(verified(blocks.mapInArrow(linecodes.starred, "a bigint, b bigint").distinct()), "links")
    release(spark)
    total = counters(lines)
    common, heavy = linecodes.classes(total)
    full, parts = total[linecodes.TABLE:] > GATHERED, parts_of(int(total[linecodes.TABLE:].sum()) // 2)
    pairs = linecodes.rarest_pairs(common, least, heavy, linecodes.promised, numbered=True)
    coded = lines.select("id", "code")
    keys = coded.mapInArrow(linecodes.dealt(linecodes.KEYS, 1, parts, linecodes.keys_of(pairs, full, False)), linecodes.DEALT)
    dealt = stage(keys.repartitionById(parts, "part").mapInArrow(linecodes.paired(least, parts), linecodes.DEALT), "dealt")
    shared = dealt.where("part < 0").mapInArrow(linecodes.crowded, "key bigint, id bigint, low bigint, members int")
    if full.any():
        rows = shared_keys(coded.mapInArrow(linecodes.keys_of(pairs, full, True), "key bigint, id bigint, n int"), least)
        shared = shared.union(fitting(rows, least).select("key", "id", "low", F.col("members").cast("int")))
    shared = stage(shared, "keys")
    release(spark)
    links = links.union(stage(verified(stars(shared.where(F.col("members") > BUSY), "low")), "links"))
    label = components(links)
    known = lines.select("id", F.col("words").alias("n"), *PRINT).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    met, turns = [], 1 + shared.count() // max(TURN, 2 * many)
    for turn in range(turns):
        part = shared.where(F.pmod("key", F.lit(turns)) == turn).drop("low").join(known, "id")
        met.append(stage(cross_pairs(part.select("key", "id", "component", "n", *PRINT, "members"), least), "met"))
        release(spark)
    both = dealt.where("part >= 0").union(reduce(DataFrame.union, met).mapInArrow(linecodes.dealt(linecodes.MET, 2, parts), linecodes.DEALT))
    pairs = both.repartitionById(parts, "part").mapInArrow(linecodes.counted, "a bigint, b bigint")
    of = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(
        F.coalesce("a_component", "a") != F.coalesce("b_component", "b"))
    rest = stage(verified(pairs.select("a", "b")), "links")
    for part in (dealt, shared, *met):
        discard(part)
    release(spark)
    label = components(links.union(rest))
    grouped = lines.join(label, "id", "left").where("n > 1 or component is not null").select(
        "h1", "h2", "first", F.coalesce("component", "id").alias("component"))
    keeper = grouped.groupBy("component").agg(F.min("first").alias("keeper"))
    grouped = stage(grouped.join(keeper, "component").select("h1", "h2", "keeper"), "groups")
    discard(lines)
    return seen.join(grouped, ["h1", "h2"]).where(~place.eqNullSafe(F.col("keeper"))).select("doc_id", "doc", "line", "keeper")


def dropped_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_lines, n_dropped, dropped), the
    latter an array of (line, keeper_doc, keeper_line)."""
    gone = line_groups(docs, least).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct(
        "line", F.col("keeper.doc_id").alias("keeper_doc"), F.col("keeper.line").alias("keeper_line")))).alias("dropped"))
    rows = _named(docs).select("doc_id", _doc_key().alias("doc"), F.when(F.col("text") == "", 0).otherwise(
        F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    return rows.join(gone, "doc", "left").select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce(
        "dropped", F.array().cast("array<struct<line:int,keeper_doc:bigint,keeper_line:int>>")).alias("dropped"))


def dedup_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with the dropped lines cut out of ``text``.  Documents that lose
    every line with words go; those that had none stay as they are."""
    doc, gone = fresh(docs, "doc"), fresh(docs, "gone")
    drops = line_groups(docs, least).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(gone))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    cut = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)),
                                                        lambda i: F.get(x, i)), "\n"))
    out = docs.withColumn(doc, F.xxhash64(F.col("doc_id").cast("long"), text)).join(drops, doc, "left")
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(cut))
    return out.where(F.col(gone).isNull() | (F.size(line_words(F.col("text").cast("string"))) > 0)).drop(doc, gone)

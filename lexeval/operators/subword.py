"""Subword ids (T1, T2, T3): greedy longest match against a vocabulary of
pieces.

A vocabulary is a table ``(token binary, id int)``: one read from a rank file
of a public tokenizer, or words and characters counted in the corpus.  It
becomes a trie of flat arrays, sent to the tasks once and walked over all
positions of an Arrow batch at a time; a text is then cut from left to right at
the longest piece that starts where the last one ended.  No row per token
leaves its task.  A character that no piece starts with is one unknown id.

A vocabulary whose trie is above ``TRIE_BYTES`` is split by the first byte of
its pieces.  Each part is a pass of its own that adds the matches of the
positions that begin with its bytes; the last step cuts the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexeval.functions.text import split_ws, strip_ws
from lexeval.operators.sizing import spread
from lexeval.operators.tokens import LABEL_IGNORE_ID, SPECIALS, UNK_ID, mask_of, pad_to, truncate

#: Largest trie that is sent to the tasks in one piece, and bytes a node takes there (label, target, id).
TRIE_BYTES, NODE_BYTES = 64 << 20, 16
#: Positions that are walked at once.
CHUNK = 1 << 20


# ---------------------------------------------------------------- vocabularies
def read_ranks(spark: SparkSession, path: str, first_id: int = len(SPECIALS)) -> DataFrame:
    """``(token, id)`` of a rank file (a base64 token and its rank a line); ids
    follow the reserved ones."""
    lines = spark.read.text(path).where(F.col("value") != "")
    parts = F.split("value", " ")
    return lines.select(F.unbase64(parts[0]).alias("token"), (parts[1].cast("int") + first_id).alias("id"))


def piece_vocab(texts: DataFrame, col: str = "text", k: int = 1000, tokenizer=split_ws) -> DataFrame:
    """``(token, id)``: after the reserved ids every character of the corpus in
    code point order, then its ``k`` most frequent words of several characters
    (count, then word).  No text of the corpus has an unknown."""
    chars = texts.select(F.explode(F.split(F.col(col), "")).alias("token")).where("token <> ''").groupBy("token").count()
    chars = chars.orderBy("token").limit(0x110000)
    words = texts.select(F.explode(tokenizer(col)).alias("token")).where(F.length("token") > 1).groupBy("token").count()
    top = words.orderBy(F.desc("count"), F.asc("token")).limit(k)
    both = chars.select(F.lit(0).alias("kind"), "token", "count").union(top.select(F.lit(1), "token", "count"))
    order = Window.orderBy("kind", F.when(F.col("kind") == 1, -F.col("count")), "token")
    # a row a character at most, and k words
    both = both.orderBy("kind", F.when(F.col("kind") == 1, -F.col("count")), "token").limit(0x110000 + k)
    return both.select(F.encode("token", "UTF-8").alias("token"), (F.row_number().over(order) + len(SPECIALS) - 1).cast("int").alias("id"))


# ------------------------------------------------------------------------ trie
class Trie:
    """Edges as one ascending array of ``node << 8 | byte``; the edge's place is
    its target's number, counted from 1.  ``ids`` has the piece that ends at a
    node, or -1; ``heads`` the nodes after the first byte and the first two, 0
    where there is none."""

    def __init__(self, pieces: dict[bytes, int]):
        pieces = {t: i for t, i in pieces.items() if t}
        tokens = sorted(pieces)
        length = np.array([len(t) for t in tokens], np.int64)
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        at, live, edges, made = np.zeros(len(tokens), np.int64), np.arange(len(tokens)), [], 0
        for depth in range(int(length.max()) if tokens else 0):
            live = live[length[live] > depth]
            keys, back = np.unique(at[live] << 8 | data[start[live] + depth], return_inverse=True)
            at[live] = made + 1 + back
            edges.append(keys)
            made += len(keys)
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.heads = np.zeros(1 << 8, np.int32), np.zeros(1 << 16, np.int32)
        for (depth, keys), before in zip(enumerate(edges[:2]), (0, len(edges[0]) if edges else 0)):
            lead = edges[0][(keys >> 8) - 1] & 255 if depth else 0
            self.heads[depth][lead << 8 | keys & 255] = before + 1 + np.arange(len(keys))
        self.ids = np.full(made + 1, -1, np.int32)
        self.ids[at] = np.array([pieces[t] for t in tokens], np.int32) if tokens else -1

    def match(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte position the length and id of the longest piece that
        starts there and ends at ``ends`` or before (length 0: none)."""
        size, found = np.zeros(len(data), np.int32), np.full(len(data), -1, np.int32)
        for lo in range(0, len(data), CHUNK):
            pos = np.arange(lo, min(lo + CHUNK, len(data)))
            node, step = np.zeros(len(pos), np.int64), 0
            while len(pos) and len(self.edges):
                if step < 2:
                    node = self.heads[step][data[pos + step] if step == 0 else data[pos].astype(np.int64) << 8 | data[pos + 1]]
                    on = node > 0
                    pos, node, step = pos[on], node[on].astype(np.int64), step + 1
                else:
                    key = node << 8 | data[pos + step]
                    edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                    on = self.edges[edge] == key
                    pos, node, step = pos[on], edge[on] + 1, step + 1
                done = self.ids[node] >= 0
                size[pos[done]], found[pos[done]] = step, self.ids[node[done]]
                on = pos + step < ends[pos]
                pos, node = pos[on], node[on]
        return size, found


def parts(vocabulary: DataFrame, limit: int = TRIE_BYTES) -> list[Trie]:
    """The vocabulary as tries of at most about ``limit`` bytes, by first byte.
    256 sums reach the driver first, then one part at a time."""
    known = vocabulary.where(F.octet_length("token") > 0).select("token", "id", F.hex(F.substring("token", 1, 1)).alias("head"))
    sizes = {r.head: r.n for r in known.groupBy("head").agg(F.sum(F.octet_length("token")).alias("n")).collect()}
    groups, room = [], 0
    for head, n in sorted(sizes.items()):
        if not groups or room < n * NODE_BYTES:
            groups.append([])
            room = limit
        groups[-1].append(head)
        room -= n * NODE_BYTES
    out = []
    for heads in groups:
        rows = (known if len(groups) == 1 else known.where(F.col("head").isin(heads))).groupBy("token").agg(F.min("id").alias("id")).collect()
        out.append(Trie({bytes(r.token): r.id for r in rows}))
    return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at - at[0]


def _cut(flat: np.ndarray, bounds: np.ndarray, size: np.ndarray, found: np.ndarray) -> pa.Array:
    """Ids of each text, from the matches of its positions."""
    width = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))  # of a character
    step, ids = np.where(size > 0, size, width), np.where(size > 0, found, UNK_ID)
    out, ends = [], [0]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        for a in range(lo, hi, CHUNK):  # a long text's steps in pieces
            b = min(a + CHUNK, hi)
            own = step[a:b].tolist()  # of this text only: the batch goes on behind it
            at = (carry if a > lo else a) - a  # noqa: F821
            while at < b - a:
                out.append(a + at)
                at += own[at]
            carry = a + at
        ends.append(len(out))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[np.array(out, np.int64)], pa.int32()))


def _ids_of(trie: Trie):
    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        flat, bounds = _flat(text)
        return _cut(flat, bounds, *trie.match(flat, np.repeat(bounds[1:], np.diff(bounds))))
    return ids


def _matches(trie: Trie):
    """Adds a part's matches to those of the parts before: two 32-bit numbers a byte."""
    @F.arrow_udf("binary")
    def add(text: pa.Array, before: pa.Array) -> pa.Array:
        flat, bounds = _flat(text)
        size, found = trie.match(flat, np.repeat(bounds[1:], np.diff(bounds)))
        out = []
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = np.stack([size[lo:hi], found[lo:hi]])
            old = np.frombuffer(before[i].as_buffer(), np.int32).reshape(2, -1) if before[i].is_valid else own
            out.append(np.where(own[0] > 0, own, old).astype(np.int32).tobytes())
        return pa.array(out, pa.binary())
    return add


def subword_ids(df: DataFrame, col: str, tries: list[Trie], out: str) -> DataFrame:
    """``df`` with the ids of the pieces of ``col`` in column ``out``."""
    if len(tries) == 1:
        return df.withColumn(out, _ids_of(tries[0])(F.col(col)))
    held = out + "__"
    df = df.withColumn(held, F.lit(None).cast("binary"))
    for trie in tries:
        df = df.withColumn(held, _matches(trie)(F.col(col), F.col(held)))

    @F.arrow_udf("array<int>")
    def cut(text: pa.Array, matches: pa.Array) -> pa.Array:
        flat, bounds = _flat(text)
        both = [np.frombuffer(m.as_buffer(), np.int32).reshape(2, -1) for m in matches]
        return _cut(flat, bounds, *(np.concatenate([m[k] for m in both] or [np.zeros(0, np.int32)]) for k in (0, 1)))

    return df.withColumn(out, cut(F.col(col), F.col(held))).drop(held)


def encode(df: DataFrame, vocabulary: DataFrame, max_source_length: int | None = 1024, max_target_length: int | None = 128,
           padding: str | bool = False, ignore_pad_token_for_loss: bool = True, keys=("example_id",), limit: int = TRIE_BYTES) -> DataFrame:
    """``input → input_ids, attention_mask``; ``target → labels``, by pieces: the
    rules of :func:`lexeval.operators.tokens.encode` for truncation, end id,
    padding and label masking.  The vocabulary is read when this is called."""
    keys = list(keys) + [c for c in ("split",) if c in df.columns and c not in keys]
    tries = parts(vocabulary, limit)
    rows = spread(df).select(*keys, F.col("input").cast("string").alias("_in"), F.col("target").cast("string").alias("_out"))
    for col, ids, most in (("_in", "ids", max_source_length), ("_out", "lab", max_target_length)):
        rows = subword_ids(rows, col, tries, "_ids").withColumn(ids, truncate(F.col("_ids"), most)).drop(col, "_ids")
    if padding == "max_length":
        if max_source_length is None or max_target_length is None:
            raise ValueError("padding to the max length needs both lengths")
        labels = pad_to(F.col("lab"), max_target_length)
        if ignore_pad_token_for_loss:
            labels = F.concat(F.col("lab"), F.array_repeat(F.lit(LABEL_IGNORE_ID), max_target_length - F.size("lab")))
        return rows.select(*keys, pad_to(F.col("ids"), max_source_length).alias("input_ids"),
                           mask_of(F.col("ids"), max_source_length).alias("attention_mask"), labels.alias("labels"))
    return rows.select(*keys, F.col("ids").alias("input_ids"), F.array_repeat(F.lit(1), F.size("ids")).alias("attention_mask"),
                       F.col("lab").alias("labels"))


# ------------------------------------------------------------------------ decode
def decoder(vocabulary: DataFrame):
    """Column function: ids → text.  Reserved and ignored ids give nothing, bytes
    that are no text the replacement character."""
    size = vocabulary.agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0
    if size > TRIE_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large to be sent to the tasks: use tokens.decode")
    table = {r.id: bytes(r.token) for r in vocabulary.collect()}

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join(table.get(i, b"") for i in x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())
    return decode


def decode(df: DataFrame, col: str, vocabulary: DataFrame, keys=("example_id",), out: str = "text", strip: bool = True) -> DataFrame:
    """``(keys..., out)``: T3, and T4 if asked."""
    text: Column = decoder(vocabulary)(F.col(col))
    return df.select(*keys, (strip_ws(text) if strip else text).alias(out))

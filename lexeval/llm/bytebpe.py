"""Byte-level BPE encoding and decoding, each distinct word encoded once.

Method.  Tasks split whole texts into pre-tokens by the tokenizer's pattern,
number the distinct ones of a block of documents and explode them as (block,
word, code), beside one row a block with the places of all pre-tokens as codes.
The words are shuffled globally by word; where equal words meet they are
encoded once and every block that asked gets their ids.  Ids return to the
block in packed rows, and the codes of each document are replaced by them in
place.  Decoding joins the ids with the token-byte table, which is the
vocabulary itself, bounded by its file and broadcast.

Both halves of the split are computed from the documents by the same scan of a
row order that a retried task sees again; the dictionary's checksum travels
with both and a difference raises an error.  A word asks once a block, so a
frequent word sends one row a block, and places never meet other words' places.
Blocks hold about ``BLOCK`` characters, or one longer text.

Ids are little-endian unsigned 32-bit integers in a binary column;
:func:`id_array` makes an array of them.

Defined cases.  A null text is empty and has no ids.  Repeated rows and null
keys are rows of their own.  Very long texts are split in pieces cut where no
pre-token can cross.  Strings of special tokens are ordinary text.  Ids that
the table lacks raise an error in decoding.  An empty table gives an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block, and from how many on a text is split in pieces.
BLOCK, LONG = 16 << 20, 1 << 20
#: Encoded words that a task packs at a time.
PACK = 1 << 18

_BOUNDARY = re.compile(r"[A-Za-z](?= [A-Za-z])")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    """``text -> pre-tokens``.  ASCII texts go through the same pattern with its
    classes written out, which is several times faster."""
    import regex

    full = regex.compile(pattern)
    ascii_ = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    fast = full if r"\p" in ascii_ else re.compile(ascii_, re.ASCII)
    return lambda text: (fast if text.isascii() else full).findall(text)


def text_pieces(text: str, size: int = LONG):
    """A long text cut between a letter and a blank before a letter."""
    at = 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size)
        if found is None:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:] if at else text


class _Codes(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _planes(codes: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of equal weight, compressed."""
    raw = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd", 3).decompress(data, 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches, split, size: int):
    """(block, keys, pre-tokens of each document, codes, dictionary) of each
    block; the partition's number is in the upper bits of the block's."""
    base, count = TaskContext.get().partitionId() << 32, 0
    keys, sizes, parts, codes, chars = [], [], [], _Codes(), 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
            n = 0
            for piece in text_pieces(text or ""):
                words = split(piece)
                parts.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                n += len(words)
            keys.append(key)
            sizes.append(n)
            chars += len(text or "")
            if chars >= size:
                yield base + count, keys, sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint32), codes
                count += 1
                keys, sizes, parts, codes, chars = [], [], [], _Codes(), 0
    if keys:
        yield base + count, keys, sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint32), codes


def _checksum(words) -> int:
    total = 0
    for w in words:
        total = zlib.crc32(w.encode("utf-8"), zlib.crc32(b"\0", total))
    return total


def _word_rows(pattern: str, size: int):
    def words(batches):
        split = splitter(pattern)
        for block, _, _, _, codes in _blocks(batches, split, size):
            known, check = list(codes), _checksum(codes)
            for lo in range(0, len(known), 50_000):
                part = known[lo:lo + 50_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), pa.array(np.full(n, check), pa.int64()),
                                                  pa.array(part, pa.string()), pa.array(np.arange(lo, lo + n), pa.int32())],
                                                 ["block", "crc", "word", "code"])
    return words


def _place_rows(pattern: str, size: int, key: pa.DataType):
    def places(batches):
        split = splitter(pattern)
        for block, keys, sizes, places_, codes in _blocks(batches, split, size):
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([_checksum(codes)], pa.int64()), pa.array([len(codes)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array([k.as_py() for k in keys], key)),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([_planes(places_)], pa.binary())],
                ["block", "crc", "n_words", "keys", "sizes", "places"])
    return places


PACKED = "block long, crc long, codes binary, lens binary, ids binary, n long"


def _encode_rows(ranks_path: str, pattern: str):
    """Words in order -> for each block the codes, lengths and ids, each word
    encoded where it first appears."""
    def encode(batches):
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        last, ids, held = None, [], []

        def flush():
            held.sort(key=lambda r: r[0])
            lo = 0
            while lo < len(held):
                hi = lo
                while hi < len(held) and held[hi][0] == held[lo][0]:
                    hi += 1
                part = held[lo:hi]
                lens = np.array([len(r[3]) for r in part], np.uint32)
                flat = np.array([t for r in part for t in r[3]], np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[0][0]], pa.int64()), pa.array([part[0][1]], pa.int64()),
                    pa.array([_planes(np.array([r[2] for r in part], np.uint32))], pa.binary()), pa.array([_planes(lens)], pa.binary()),
                    pa.array([_planes(flat)], pa.binary()), pa.array([len(part)], pa.int64())],
                    ["block", "crc", "codes", "lens", "ids", "n"])
                lo = hi

        for batch in batches:
            for block, crc, word, code in zip(*(c.to_pylist() for c in batch.columns)):
                if word != last:
                    last, ids = word, enc.encode_ordinary(word)
                held.append((block, crc, code, ids))
                if len(held) >= PACK:
                    yield from flush()
                    held = []
        yield from flush()
    return encode


def _fill(key: pa.DataType):
    """The places of a block and the packed ids of its words -> ids of each document."""
    def fill(places: pa.Table, packed: pa.Table) -> pa.Table:
        out_keys, out_ids = [], []
        for row in places.to_pylist():
            n = row["n_words"]
            at, size, flats, base = np.full(n, -1, np.int64), np.zeros(n, np.int64), [], 0
            for p in packed.to_pylist():
                if p["crc"] != row["crc"]:
                    raise RuntimeError("the documents changed their order between two reads of them; write them to a table first")
                codes, lens = _unplanes(p["codes"], p["n"]), _unplanes(p["lens"], p["n"]).astype(np.int64)
                flat = _unplanes(p["ids"], int(lens.sum()))
                at[codes], size[codes] = base + np.cumsum(lens) - lens, lens
                flats.append(flat)
                base += len(flat)
            if n and at.min() < 0:
                raise RuntimeError("words of a block are missing")
            flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
            codes = _unplanes(row["places"], sum(row["sizes"]))
            lo = 0
            for k, m in zip(row["keys"], row["sizes"]):
                out_keys.append(k)
                ids = [gather(flat, at, size, codes[a:min(a + LONG, lo + m)]) for a in range(lo, lo + m, LONG)]
                out_ids.append(b"".join(x.astype("<u4").tobytes() for x in ids))
                lo += m
        return pa.table([pa.array(out_keys, key), pa.array(out_ids, pa.binary())], ["key", "ids"])
    return fill


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs ``flat[at[c]:at[c] + size[c]]`` of all codes, one after another."""
    n = size[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at[codes] - ends + n, n)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, ids) of every row of ``docs``.  The rows must come in the same order
    whenever they are read, as they do from files."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    arrow = to_arrow_type(kind)
    words = rows.mapInArrow(_word_rows(pattern, block), "block long, crc long, word string, code int")
    packed = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_rows(ranks_path, pattern), PACKED)
    places = rows.mapInArrow(_place_rows(pattern, block, arrow),
                             f"block long, crc long, n_words long, keys array<{kind.simpleString()}>, sizes array<bigint>, places binary")
    out = places.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(_fill(arrow), f"key {kind.simpleString()}, ids binary")
    return out.withColumnRenamed("key", key)


def decoder(spark, ranks_path: str):
    """Column function: ids -> bytes, through the broadcast token-byte table."""
    ranks = read_ranks(ranks_path)
    table = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        token = shared.value
        out = []
        for value in ids:
            if not value.is_valid:
                out.append(None)
                continue
            found = np.frombuffer(value.as_buffer(), "<u4")
            try:
                out.append(b"".join(b"".join(map(token.__getitem__, found[a:a + LONG].tolist())) for a in range(0, len(found), LONG)))
            except (IndexError, TypeError):
                raise ValueError("an id is not in the token table") from None
        return pa.array(out, pa.binary())
    return decode


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``encoded`` with the decoded bytes of each row."""
    return encoded.withColumn(out, decoder(encoded.sparkSession, ranks_path)(F.col(ids)))


def id_array(ids: Column) -> Column:
    """Packed ids as an array."""
    @F.arrow_udf("array<bigint>")
    def unpack(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_buffer(), "<u4").tolist() if x.is_valid else None for x in packed], pa.list_(pa.int64()))
    return unpack(ids)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))

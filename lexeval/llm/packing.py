"""Vector bin packing of training examples into fixed-length sequences.

An example has tokens, of which some bear loss; a sequence has three limits:
tokens, segments and loss-bearing tokens.  Examples are cut into full-length
pieces first.  What is left over is packed by the dot-product heuristic: of
the pieces that fit, the one whose demand vector has the largest dot product
with the sequence's remaining capacity goes in.  Where none fits, the largest
piece is cut to fill the gap.  A sequence that ends short is cut at powers of
two, so it needs no padding.

Packing runs inside each input partition over a bounded buffer, in order: no
shuffle, no group that a hot key could fill, and a task that is run again gives
the same pieces.  A sequence id is the partition's number in the upper bits and
a count in the lower 40.

Defined cases.  A null text is an empty one: its only token is the end token.
Repeated rows are packed one by one.  A null id is kept as null.  Long texts
are tokenised whole; full pieces leave the buffer at once.  An empty table
gives an empty result.  Columns that are not named are not read.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
MAX_SEGMENTS = 256
#: Left-over pieces that one heuristic run looks at.
BUFFER = 2048
END_TOKEN = 1

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long, segment long")


def encoder(tokenizer: str):
    """``text -> ids`` of a byte-level BPE.  ``*.json`` is read by the
    tokenizers library.  Where the same vocabulary lies beside it as ranks, the
    rank encoder gives the same ids about five times as fast and is used;
    ``tests/llm`` compares the two.  Strings of special tokens are ordinary
    text either way."""
    import os

    ranks_file = os.path.splitext(tokenizer)[0] + ".tiktoken"
    if os.path.exists(ranks_file):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        import public_tokenizers

        fast = tiktoken.Encoding(os.path.basename(ranks_file), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})
        return fast.encode_ordinary
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids


_encoders: dict = {}


def _encoder(tokenizer: str):
    if tokenizer not in _encoders:
        _encoders[tokenizer] = encoder(tokenizer)
    return _encoders[tokenizer]


def _cut_sizes(n: int, length: int) -> list[int]:
    """A full sequence stays whole; a shorter one is cut at powers of two."""
    out = []
    while n:
        out.append(length if n == length else 1 << (n.bit_length() - 1))
        n -= out[-1]
    return out


class Packer:
    """Fills sequences from a buffer of pieces.  A piece is (key, start, ids,
    loss mask or None); ``emit`` gets the segments of each closed sequence."""

    def __init__(self, length: int, segments: int, loss: int, base: int):
        self.limits = np.array([length, segments, loss], float)
        self.length, self.count, self.base = length, 0, base
        self.buffer, self.rows = [], []

    def _loss(self, piece) -> int:
        return len(piece[2]) if piece[3] is None else int(piece[3].sum())

    def _close(self, bin_) -> None:
        """Write a sequence; a short one in runs whose lengths are powers of two."""
        sizes = _cut_sizes(sum(len(p[2]) for p in bin_), self.length)
        at, seq, segment = 0, self.base + self.count, 0
        for key, start, ids, loss in bin_:
            done = 0
            while done < len(ids):
                take = min(len(ids) - done, sizes[0] - at)
                part = np.ascontiguousarray(ids[done:done + take], dtype="<u4")
                n_loss = take if loss is None else int(loss[done:done + take].sum())
                self.rows.append((key[0], start + done, take, zlib.crc32(part.tobytes()), key[1], seq, at, n_loss, segment))
                at, done, segment = at + take, done + take, segment + 1
                if at == sizes[0]:
                    sizes.pop(0)
                    self.count += 1
                    at, seq, segment = 0, self.base + self.count, 0

    def add(self, key, ids: np.ndarray, loss=None) -> None:
        """An example; full-length pieces within the loss limit go out at once."""
        at = 0
        while len(ids) - at >= self.length:
            mask = None if loss is None else loss[at:at + self.length]
            piece = (key, at, ids[at:at + self.length], mask)
            if self._loss(piece) > self.limits[2]:
                break
            self._close([piece])
            at += self.length
        while at < len(ids):
            end = min(at + self.length, len(ids))
            if loss is not None:  # a piece alone must respect the loss limit
                over = np.flatnonzero(np.cumsum(loss[at:end]) > self.limits[2])
                end = at + int(over[0]) if len(over) else end
            else:
                end = min(end, at + int(self.limits[2]))
            self.buffer.append((key, at, ids[at:end], None if loss is None else loss[at:end]))
            at = end
        if len(self.buffer) >= BUFFER:
            self.pack(final=False)

    def pack(self, final: bool) -> None:
        items = self.buffer
        n = len(items)
        need = np.array([[len(p[2]), 1, self._loss(p)] for p in items], float).reshape(n, 3)
        unit, free = need / self.limits, np.ones(n, bool)
        keep = 0 if final else BUFFER // 8  # pieces that wait for company
        left = n
        while left > keep:
            bin_, rest = [], self.limits.copy()
            while left and rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
                fits = free & (need <= rest).all(axis=1)
                if fits.any():
                    score = np.where(fits, unit @ (rest / self.limits), -1)
                    i = int(score.argmax())
                    bin_.append(items[i])
                    rest -= need[i]
                    free[i] = False
                    left -= 1
                    continue
                i = int(np.where(free, need[:, 0], -1).argmax())  # none fits: cut the longest to fill the gap
                key, start, ids, loss = items[i]
                take = int(min(rest[0], len(ids)))
                if loss is not None:
                    over = np.flatnonzero(np.cumsum(loss[:take]) > rest[2])
                    take = int(over[0]) if len(over) else take
                else:
                    take = int(min(take, rest[2]))
                if take <= 0:
                    break
                part = (key, start, ids[:take], None if loss is None else loss[:take])
                bin_.append(part)
                rest -= np.array([take, 1, self._loss(part)])
                items[i] = (key, start + take, ids[take:], None if loss is None else loss[take:])
                need[i] = [len(ids) - take, 1, self._loss(items[i])]
                unit[i] = need[i] / self.limits
            self._close(bin_)
        self.buffer = [items[i] for i in np.flatnonzero(free)]

    def take_rows(self):
        rows, self.rows = self.rows, []
        return rows


def _batch(rows) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=names)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, max_segments: int = MAX_SEGMENTS,
         max_loss: int | None = None, prompt: Column | None = None) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)``.  Tokens of ``text`` bear
    loss; those of the optional ``prompt`` text before it do not.
    ``loss_tokens`` and ``segment`` (its place in the sequence) follow the
    columns of the piece."""
    limit = length if max_loss is None else max_loss

    def run(batches):
        encode = _encoder(tokenizer)
        task = TaskContext.get()
        packer = Packer(length, max_segments, limit, (task.partitionId() if task else 0) << 40)
        for batch in batches:
            for key, before, text in zip(*(c.to_pylist() for c in batch.columns)):
                tail = encode(text) if text else []
                tail.append(END_TOKEN)
                head = encode(before) if before else []
                ids = np.array(head + tail, np.uint32)
                mask = None
                if head:
                    mask = np.arange(len(ids)) >= len(head)
                packer.add((key, len(ids)), ids, mask)
                if len(packer.rows) >= 4096:
                    yield _batch(packer.take_rows())
        packer.pack(final=True)
        if packer.rows:
            yield _batch(packer.take_rows())

    first = F.lit(None).cast("string") if prompt is None else prompt.cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), first.alias("prompt"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

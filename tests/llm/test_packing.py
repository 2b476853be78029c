"""Packing: an exact round trip, the limits and the padding."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexeval.llm.packing import END_TOKEN, Packer, encoder, pack
from lexeval.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, ids_of, length=2048):
    """Every id of every document in one piece; sequences gapless, within limits."""
    by_seq = {}
    pieces = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == length or at & (at - 1) == 0
    for doc, ids in ids_of.items():
        ids = np.array(ids + [END_TOKEN], "<u4")
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces


def test_round_trip_of_the_query(spark):
    rows = QUERIES["op5_packing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(rows, dict(zip([d.doc_id for d in docs], reference_ids([d.text for d in docs]))))


def test_edge_cases(spark):
    texts = [None, "", "a", " ", "<|endoftext|> x", "é\U0001f600‍ " * 3000, "word " * 50000] + ["tiny"] * 700
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = pack(df.repartition(3), P.path("byte_bpe_50k.json")).collect()
    check(rows, dict(enumerate(reference_ids([t or "" for t in texts]))))
    assert pack(df.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_fast_encoder_equals_the_library():
    texts = ["Hello  world\n\n x", "<|endoftext|>", "ä" * 99, "\t\r\n  ", "123,456.78 l'été can't", "\U0001f600" * 7, "\x00\x7f"]
    assert [encoder(P.path("byte_bpe_50k.json"))(t) for t in texts] == reference_ids(texts)


def test_instruction_limits():
    """Prompts bear no loss; all three limits hold in every sequence."""
    rng = np.random.default_rng(0)
    p = Packer(256, 6, 100, 0)
    total = {}
    for i in range(3000):
        n = int(rng.integers(1, 600))
        mask = np.arange(n) >= rng.integers(0, n + 1)
        total[i] = (n, int(mask.sum()))
        p.add((i, n), np.arange(n, dtype=np.uint32), mask)
    p.pack(final=True)
    seqs, seen = {}, {}
    for key, start, length, crc, n, seq, offset, loss, segment in p.rows:
        s = seqs.setdefault(seq, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + length, s[1] + 1, s[2] + loss
        d = seen.setdefault(key, [0, 0])
        d[0], d[1] = d[0] + length, d[1] + loss
    assert all(a <= 256 and b <= 6 and c <= 100 for a, b, c in seqs.values())
    assert {k: tuple(v) for k, v in seen.items()} == total


def test_prompt_tokens_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "say it", "done now"), (2, None, "x")], "doc_id long, ask string, text string")
    rows = pack(df, P.path("byte_bpe_50k.json"), prompt=F.col("ask")).collect()
    a, b = reference_ids(["say it", "done now"])
    assert sum(r.loss_tokens for r in rows if r.doc_id == 1) == len(b) + 1
    assert sum(r.length for r in rows if r.doc_id == 1) == len(a) + len(b) + 1

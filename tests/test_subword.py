"""Subword ids against a plain longest match."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexeval.operators import subword as W
from lexeval.operators.tokens import EOS_ID, LABEL_IGNORE_ID, PAD_ID, UNK_ID


def longest(text, pieces):
    data, at, out = (text or "").encode(), 0, []
    most = max(map(len, pieces), default=0)
    while at < len(data):
        for n in range(min(most, len(data) - at), 0, -1):
            if data[at:at + n] in pieces:
                out.append(pieces[data[at:at + n]])
                at += n
                break
        else:
            out.append(UNK_ID)
            at += next(n for n in (1, 2, 3, 4) if data[at:at + n].decode("utf-8", "ignore"))
    return out


def fixture():
    rng = random.Random(1)
    pieces = {p.encode(): i + 4 for i, p in enumerate(["a", "ab", "abc", "abcde", "b", "c", "é", "éa", "日本", "日", " ", "e d", "\n"])}
    texts = ["", None, "abcdabcde", "日本語 é", "🙂ab🙂", "zzz", "éaéé\n\n", "x" * 50]
    return pieces, texts + ["".join(rng.choice("abcde é日本\nz") for _ in range(rng.randrange(60))) for _ in range(200)]


def table(spark, pieces):
    return spark.createDataFrame([(bytearray(t), i) for t, i in pieces.items()], "token binary, id int")


@pytest.mark.parametrize("limit", [W.TRIE_BYTES, 1])
def test_equals_the_plain_longest_match(spark, limit, monkeypatch):
    pieces, texts = fixture()
    monkeypatch.setattr(W, "CHUNK", 37)
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "example_id long, input string, target string")
    assert (len(W.parts(table(spark, pieces), limit)) > 1) == (limit == 1)
    got = {r.example_id: r for r in W.encode(df, table(spark, pieces), None, None, limit=limit).collect()}
    for i, t in enumerate(texts):
        assert got[i].input_ids == longest(t, pieces) + [EOS_ID] == got[i].labels and len(got[i].attention_mask) == len(got[i].input_ids)


def test_truncation_padding_and_masks(spark):
    pieces, _ = fixture()
    df = spark.createDataFrame([(1, "a b a b", "abc")], "example_id long, input string, target string")
    r = W.encode(df, table(spark, pieces), 4, 4, padding="max_length").first()
    assert r.input_ids == longest("a b", pieces) + [EOS_ID] and r.attention_mask == [1] * 4
    assert r.labels == longest("abc", pieces) + [EOS_ID, LABEL_IGNORE_ID, LABEL_IGNORE_ID]
    r = W.encode(df, table(spark, pieces), 9, 4, padding="max_length", ignore_pad_token_for_loss=False).first()
    assert r.input_ids[-1] == PAD_ID and r.attention_mask[-1] == 0 and r.labels[-1] == PAD_ID


def test_corpus_pieces_have_no_unknown_and_decode_to_the_text(spark):
    _, texts = fixture()
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "example_id long, input string, target string")
    voc = W.piece_vocab(df, "input", 20).cache()
    e = W.encode(df, voc, None, None)
    assert e.where(F.array_contains("labels", UNK_ID)).count() == 0
    got = {r.example_id: r.text for r in W.decode(e, "labels", voc, strip=False).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert voc.select("id").distinct().count() == voc.count() == voc.select("token").distinct().count()


def test_public_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    voc = W.read_ranks(spark, public.path("byte_bpe_multi_50k.tiktoken")).cache()
    pieces = {bytes(r.token): r.id for r in voc.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("input"), F.col("text").alias("target"))
    e = W.encode(docs, voc, None, None, keys=("doc_id",)).cache()
    got = {r.doc_id: r.input_ids for r in e.collect()}
    rows = docs.collect()
    for r in rows[:40]:
        assert got[r.doc_id] == longest(r.input, pieces) + [EOS_ID]
    back = {r.doc_id: r.text for r in W.decode(e, "labels", voc, ("doc_id",), strip=False).collect()}
    assert back == {r.doc_id: r.input for r in rows}


def test_encoding_has_no_exchange(spark):
    pieces, _ = fixture()
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("example_id"), F.col("text").alias("input"), F.lit("").alias("target"))
    plan = W.encode(df.repartition(16), table(spark, pieces))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # the repartition of the test itself


def test_trie_of_nothing():
    trie = W.Trie({})
    size, _ = trie.match(np.frombuffer(b"abc", np.uint8), np.full(3, 3))
    assert size.tolist() == [0, 0, 0]


def test_cutting_a_text_does_not_touch_the_texts_behind_it():
    pieces = {bytes([97 + i]): i + 4 for i in range(26)} | {b"abc": 30, b"ab": 31}
    texts = ["abcab" * 100] * 2500  # a batch of 1.25 MB
    flat, bounds = W._flat(pa.array(texts))
    size, found = W.Trie(pieces).match(flat, np.repeat(bounds[1:], np.diff(bounds)))
    began = time.process_time()
    got = W._cut(flat, bounds, size, found)
    assert time.process_time() - began < 8  # each text made a list of the next million positions: 17.6 s
    assert got[0].as_py() == got[2499].as_py() == [30, 31] * 100 and len(got) == 2500

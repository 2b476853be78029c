"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib
import random
import struct

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from lexeval.llm import bytebpe as B

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(7)
    out = [None, "", " ", "  ", "\n\n  a", "a \t\n b", "it's we'll DON'T 'S ''s", "<|endoftext|>", "été 日本語 ١٢٣ x²½", "a b  c\x85d\x1ce",
           "́combining é", "🙂👍🏽 ok", "\x00\x01", "same", "same", "x" * 3000, " " * 500 + "y", "end  "]
    alphabet = "ab cé日 1²\n\t'sß.,!🙂 　x"
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, b"1", 2) for i, t in enumerate(rows)], "doc_id long, text string, ids binary, block int").repartition(4).cache()


def test_equals_the_library_and_round_trips(spark, library):
    rows = texts()
    df = B.decode(B.encode(frame(spark, rows), RANKS, PATTERN, block=200), RANKS).withColumn("list", B.id_array(F.col("ids")))
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        want = library.encode_ordinary(t or "")
        assert got[i].list == want, t
        assert bytes(got[i].bytes) == (t or "").encode()
    digests = {r.doc_id: r for r in B.digests(df).collect()}
    want = library.encode_ordinary(rows[8])
    assert digests[8].n_tokens == len(want)
    assert digests[8].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert digests[8].decoded_sha256 == hashlib.sha256(rows[8].encode()).hexdigest()


def test_repeated_and_null_keys_and_empty_table(spark, library):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n) for r in B.encode(df, RANKS, PATTERN).select("doc_id", (F.octet_length("ids") / 4).cast("int").alias("n")).collect()), key=str)
    assert got == [(1, 1), (1, 2), (1, 2), (None, 2)]
    assert B.digests(B.decode(B.encode(df.limit(0), RANKS, PATTERN), RANKS)).collect() == []


def test_long_texts_are_cut_where_nothing_changes(spark, library):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "été ", "  ", "\n", "x1 ", "'s "]) for _ in range(400_000))
    split = B.splitter(PATTERN)
    parts = list(B.text_pieces(text, 10_000))
    assert "".join(parts) == text and len(parts) > 50
    assert [w for p in parts for w in split(p)] == split(text)
    df = spark.createDataFrame([(1, text), (2, "日" * 3_000)], "doc_id long, text string")
    got = {r.doc_id: r.l for r in B.encode(df, RANKS, PATTERN).select("doc_id", B.id_array(F.col("ids")).alias("l")).collect()}
    assert got[1] == library.encode_ordinary(text)


def test_unknown_ids_are_an_error(spark):
    df = spark.createDataFrame([(struct.pack("<I", 10 ** 6),)], "ids binary")
    with pytest.raises(Exception, match="not in the token table"):
        B.decode(df, RANKS).collect()


def test_every_document_of_the_given_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in B.digests(B.decode(B.encode(docs, RANKS, PATTERN), RANKS)).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()

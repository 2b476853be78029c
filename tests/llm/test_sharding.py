"""Extendible hashing against an insert-by-insert directory, hot keys, the SQL twin."""

import hashlib
import random

from pyspark.sql import functions as F

from lexeval.llm import sharding as S
from lexeval.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare


def bits(value):
    return format(int(hashlib.md5(("null" if value is None else str(value)).encode()).hexdigest()[:15], 16), "060b")


def brute(rows, limit):
    """Split buckets one by one until each fits; rows are (key, bytes)."""
    done, todo = {}, [("", rows)]
    while todo:
        prefix, own = todo.pop()
        if sum(b for _, b in own) <= limit or len(own) < 2 or len(prefix) == S.KEY_BITS:
            done[prefix] = own
            continue
        for bit in "01":
            half = [r for r in own if bits(r[0])[len(prefix)] == bit]
            if half:
                todo.append((prefix + bit, half))
    return done


def run(spark, rows, limit):
    df = spark.createDataFrame(rows, "key string, b long").repartition(4)
    return S.assign(df, F.col("key"), F.col("b"), limit).collect()


def test_against_splits_one_by_one(spark):
    rng = random.Random(6)
    rows = [(str(i), rng.randrange(2000)) for i in range(3000)] + [(None, 5), ("", 0), ("", 0), ("big", 10 ** 7)]
    for limit in (200, 5000, 400_000, 10 ** 9):
        want = {}
        for prefix, own in brute(rows, limit).items():
            for k, b in own:
                want.setdefault(k, []).append((prefix, sum(x for _, x in own), len(own)))
        got = {}
        for r in run(spark, rows, limit):
            got.setdefault(r.key, []).append((r.shard, r.shard_bytes, r.shard_rows))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_hot_key_beyond_the_limit_is_split(spark):
    rows = [("hot", 100)] * 500 + [(f"k{i}", 100) for i in range(500)]
    got = run(spark, rows, 1000)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.b
    assert len(got) == 1000 and max(size.values()) <= 1000
    assert all(r.shard_bytes == size[r.shard] for r in got)
    assert all(len(r.shard) > S.KEY_BITS and r.shard.startswith(bits("hot")) for r in got if r.key == "hot" and r.shard_rows)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard inside another


def test_empty_table_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "y" * 50) for i in range(40)], "doc_id long, text string")
    assert S.assign(df.limit(0), F.col("doc_id"), F.octet_length("text"), 10).collect() == []
    S.write_shards(df, str(tmp_path / "out"), F.col("doc_id"), F.octet_length("text"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 500").count() == 0


def test_a_large_directory_gives_the_same_rows(spark, monkeypatch):
    rows = [(str(i % 700), i % 90) for i in range(2000)]
    small = sorted(map(tuple, run(spark, rows, 900)))
    monkeypatch.setattr(S, "BROADCAST_SHARDS", 0)
    assert sorted(map(tuple, run(spark, rows, 900))) == small


def test_clashing_columns_hot_keys_and_nulls_come_back_from_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_BYTES", 300)
    rows = [("hot" if i % 3 else f"k{i}", "t" * (i % 50) if i % 7 else None, i, "own", [i]) for i in range(600)]
    rows += [(None, "", None, None, None)] * 3
    df = spark.createDataFrame(rows, "key string, text string, shard_Bytes long, SHARD string, __row array<int>").repartition(5)
    assert S.shard_column(df) == "shard_"
    S.write_shards(df, str(tmp_path / "out"), F.col("key"), S.row_bytes(df), 2000)
    back = S.read_shards(spark, str(tmp_path / "out"), df.schema).withColumn("b", S.row_bytes(df)).collect()
    assert sorted((tuple(r)[:5] for r in back), key=str) == sorted((tuple(r) for r in df.collect()), key=str)
    size, files = {}, {}
    for r in back:
        size[r.shard_] = size.get(r.shard_, 0) + r.b
    for f in (tmp_path / "out").rglob("*.parquet"):
        files[f.parent.name] = files.get(f.parent.name, 0) + 1
    assert max(size.values()) <= 2000 and set(files) == {f"shard_=b{x}" for x in size}
    assert any(len(x) > S.KEY_BITS for x in size)  # the hot key
    S.write_shards(df.limit(0), str(tmp_path / "none"), F.col("key"), S.row_bytes(df), 2000)
    assert S.read_shards(spark, str(tmp_path / "none"), df.schema).collect() == []


def test_written_shards_match_sql(spark, tmp_path):
    def query(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return S.sharded(docs, str(tmp_path / "sf"), F.col("doc_id"), 100_000).select(
            "doc_id", "shard", F.length("shard").alias("depth"), "bytes", "shard_bytes", "shard_rows",
            (F.col("shard_bytes") > 100_000).alias("oversized"))
    info = compare(spark, "/root/testdata/sf0.01", "op3", query, S.oracle_sql(100_000))
    assert info["ok"] and info["spark_rows"] == 1000, info
    assert len(list((tmp_path / "sf").glob("shard=b*"))) > 20


def test_query_matches_sql(spark):
    info = compare(spark, "/root/testdata/sf0.01", "op3", QUERIES["op3_sharding"], ORACLE["op3_sharding"])
    assert info["ok"] and info["spark_rows"] == 1000, info

"""Operator fixtures: the reference's inline self-tests and the edge cases of FIXTURES.md."""
import pytest
from pyspark.sql import functions as F

from lexeval.operators import align, recipes, tokens


def test_flatten_references_inline_fixture(spark):
    df = spark.createDataFrame([(0, "p1", "s1", ["a", "b"]), (1, "p2", "s2", ["c", "d"]), (2, "p3", "s3", ["e", "f"])],
                               "example_id long, prediction string, source string, references array<string>")
    rows = align.flatten_references(df).orderBy("example_id", "ref_idx").collect()
    assert [r.reference for r in rows] == list("abcdef")
    assert [r.prediction for r in rows] == ["p1", "p1", "p2", "p2", "p3", "p3"]
    assert [r.source for r in rows] == ["s1", "s1", "s2", "s2", "s3", "s3"]
    assert [r.example_id for r in rows] == [0, 0, 1, 1, 2, 2]


def test_best_per_owner_inline_fixture_and_gaps(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 2, 2, 2, 2], [float(x) for x in range(1, 10)])),
                               "example_id long, score double")
    assert [r.score for r in align.best_per_owner(df).orderBy("example_id").collect()] == [3, 5, 9]
    gaps = spark.createDataFrame([(0, 1.0), (2, 2.0), (2, 3.0)], "example_id long, score double")
    owners = spark.range(3).withColumnRenamed("id", "example_id")
    got = owners.join(align.best_per_owner(gaps), "example_id", "left").orderBy("example_id").collect()
    assert [r.score for r in got] == [1.0, None, 3.0]


def test_dedup_window_of_three(spark):
    df = spark.createDataFrame([(1, i, s, str(i)) for i, s in enumerate("abcada")],
                               "run long, pos long, source string, prediction string")
    got = align.dedup_recent_sources(df).orderBy("pos").collect()
    assert "".join(r.source for r in got) == "abcda"


def test_dedup_state_resets_per_run(spark):
    df = spark.createDataFrame([(r, i, s, "") for r in (1, 2) for i, s in enumerate("aab")],
                               "run long, pos long, source string, prediction string")
    assert align.dedup_recent_sources(df).count() == 4


def test_lexicalization_filter_edges(spark):
    df = spark.createDataFrame([(1, (["t1", "t2", "t3", "t4"], ["cs", "cs", "en", "cs"],
                                     ["deepl-v2", "DeepL", "deepl", "other"])),
                                (2, (["x", "y"], ["cs"], ["deepl", "deepl"])),
                                (3, (["z"], ["en"], ["deepl"]))],
                               "example_id long, lex struct<text:array<string>,lang:array<string>,source:array<string>>")
    got = {r.example_id: r.lex for r in recipes.filter_lexicalizations(df).collect()}
    assert got == {1: ["t1"], 2: ["x"], 3: []}


def test_linearise_requires_one_set(spark):
    ok = spark.createDataFrame([(1, ([["a", "b"]],))], "example_id long, modified_triple_sets struct<mtriple_set:array<array<string>>>")
    assert recipes.linearise_triples(ok).first().input == "a - b"
    for bad in ([["a"], ["b"]], []):
        df = spark.createDataFrame([(1, (bad,))], "example_id long, modified_triple_sets struct<mtriple_set:array<array<string>>>")
        with pytest.raises(Exception):
            recipes.linearise_triples(df).collect()


def test_flatten_empty_references_vanish(spark):
    df = spark.createDataFrame([(1, "i1", ["r1", "r2"]), (2, "i2", [])], "example_id long, input string, lex array<string>")
    assert recipes.flatten_first(df).count() == 1
    assert recipes.flatten_all(df).count() == 2


def test_subset_limits(spark):
    df = spark.range(10).select(F.col("id").alias("example_id"), F.lit("train").alias("split"))
    assert recipes.select_subset(df, {"train": None}).count() == 10
    assert recipes.select_subset(df, {"train": 0}).count() == 0
    assert recipes.select_subset(df, {"train": 50}).count() == 10
    assert [r.example_id for r in recipes.select_subset(df, {"train": 3}).collect()] == [0, 1, 2]


def test_subset_of_several_splits_keeps_null_splits(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([None, "a", "b", None, "a", "c", "b", "a", "c"])], "example_id long, split string")
    got = recipes.select_subset(df, {"a": 2, "b": 1, "c": 0, "d": 5})
    assert sorted(r.example_id for r in got.collect()) == [0, 1, 2, 3, 4]
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # kept small in each task


def test_prepare_custom_needs_columns(spark):
    df = spark.createDataFrame([(1, "x")], "example_id long, input string")
    with pytest.raises(ValueError):
        recipes.prepare(df, None)


def _vocab(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens.SPECIALS + ["a", "b"])], "token string, id int")


def test_label_masking_only_with_flag_and_max_length(spark):
    df = spark.createDataFrame([(1, "a b", "a")], "example_id long, input string, target string")
    v = _vocab(spark)
    padded = tokens.encode(df, v, 6, 5, padding="max_length", ignore_pad_token_for_loss=True).first()
    assert padded.input_ids == [4, 5, 1, 0, 0, 0] and padded.attention_mask == [1, 1, 1, 0, 0, 0]
    assert padded.labels == [4, 1, -100, -100, -100]
    noflag = tokens.encode(df, v, 6, 5, padding="max_length", ignore_pad_token_for_loss=False).first()
    assert noflag.labels == [4, 1, 0, 0, 0]
    nopad = tokens.encode(df, v, 6, 5, padding=False).first()
    assert nopad.labels == [4, 1] and nopad.attention_mask == [1, 1, 1]


def test_rows_that_share_an_id_are_encoded_one_by_one(spark):
    df = spark.createDataFrame([(1, "train", "a", "b"), (1, "train", "a", "zz zz")], "example_id long, split string, input string, target string")
    rows = sorted((r.input_ids, r.labels) for r in tokens.encode(df, _vocab(spark), 10, 10).collect())
    assert rows == [([4, 1], [2, 2, 1]), ([4, 1], [5, 1])]
    assert "split" in tokens.encode(df, _vocab(spark)).columns


def test_vocabularies_of_any_size_have_one_plan(spark):
    import re
    n = 60_000
    big = spark.range(n).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") + 4).cast("int").alias("id"))
    big = big.union(spark.createDataFrame([(t, i) for i, t in enumerate(tokens.SPECIALS)], "token string, id int"))
    df = spark.createDataFrame([(1, "w0 w59999 nope", "w5")], "example_id long, input string, target string")
    e = tokens.encode(df, big, 10, 10)
    assert e.first().input_ids == [4, n + 3, 2, 1]
    assert tokens.decode(e, "input_ids", big).first().text == "w0 w59999"
    nodes = lambda d: re.findall(r"(?:Join|Aggregate|Generate)", d._jdf.queryExecution().optimizedPlan().toString())
    sizes = [tokens.build_vocab(big.withColumnRenamed("token", "text"), k=k) for k in (500, 50_000)]
    assert nodes(tokens.encode(df, sizes[0])) == nodes(tokens.encode(df, sizes[1]))


def test_a_learned_vocabulary_is_broadcast(spark):
    texts = spark.range(300).select(F.concat(F.lit("w"), "id").alias("text"))
    v = tokens.build_vocab(texts, k=100)
    assert tokens.estimated_bytes(v) <= tokens.DEFAULT_BROADCAST_BYTES
    assert dict(v.dtypes) == {"token": "string", "id": "int"}
    df = texts.select(F.lit(1).alias("example_id"), F.col("text").alias("input"), F.lit("").alias("target"))
    plan = tokens.encode(df, v)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    fixed = {r.token: r.id for r in v.collect() if r.token in tokens.SPECIALS + tokens.lang_tokens()}
    assert [fixed[t] for t in tokens.SPECIALS] == [0, 1, 2, 3] and [fixed[t] for t in tokens.lang_tokens()] == list(range(104, 110))


def test_first_words_are_those_of_the_whole_split(spark):
    from lexeval.functions.text import first_words, split_ws
    texts = ["", " ", "a", " a", "a ", "  a  b ", "a b c d e f", "\t a b\u00a0c\u2003d e ", "a b c ", " a b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4):
        for r in df.select("t", F.slice(first_words("t", n), 1, n).alias("few"), F.slice(split_ws("t"), 1, n).alias("all")).collect():
            assert r.few == r["all"] == r.t.split()[:n], (n, r)


def test_sides_with_their_own_vocabulary(spark):
    df = spark.createDataFrame([(1, "a b", "a b")], "example_id long, input string, target string")
    other = spark.createDataFrame([(t, i) for i, t in enumerate(tokens.SPECIALS + ["b"])], "token string, id int")
    r = tokens.encode(df, _vocab(spark), target_vocab=other).first()
    assert (r.input_ids, r.labels) == ([4, 5, 1], [2, 4, 1])


def test_reserved_tokens_in_the_corpus_keep_their_ids(spark):
    texts = spark.createDataFrame([("<s> a <s> <s> __cs__ b",)], "text string")
    v = tokens.build_vocab(texts, k=5)
    assert v.count() == v.select("token").distinct().count()
    df = spark.createDataFrame([(1, "<s> a", "a")], "example_id long, input string, target string")
    assert tokens.encode(df, v).first().input_ids == [3, 4, 1]


def test_building_token_queries_starts_no_job(spark):
    from lexeval.plans.queries import QUERIES
    sc = spark.sparkContext
    for name in ("encode_padded", "collate_batches", "decode", "gen_len", "lang_tag"):
        sc.setJobGroup("build-" + name, name)
        QUERIES[name](spark, "/root/testdata/sf0.001")
        jobs = sc.statusTracker().getJobIdsForGroup("build-" + name)
        assert len(jobs) <= 3, (name, jobs)  # reading Parquet schemas only
    sc.setJobGroup("default", "default")


def test_collate_fp16_width(spark):
    df = spark.createDataFrame([(1, 0, list(range(9)), [1] * 9, [5, 1]), (2, 0, [4, 1], [1, 1], [4, 5, 6, 1])],
                               "example_id long, batch_id long, input_ids array<int>, attention_mask array<int>, labels array<int>")
    rows = {r.example_id: r for r in tokens.collate(df, pad_to_multiple_of=8).collect()}
    assert len(rows[2].input_ids) == 16 and rows[2].attention_mask.count(0) == 14
    assert rows[1].labels == [5, 1] + [-100] * 6


def test_decoder_inputs_and_decode(spark):
    v = _vocab(spark)
    df = spark.createDataFrame([(1, [4, 5, 1, -100])], "example_id long, labels array<int>")
    assert df.select(tokens.decoder_inputs(F.col("labels")).alias("d")).first().d == [1, 4, 5, 1]
    assert tokens.decode(df, "labels", v).first().text == "a b"


def test_alignment_guard(spark):
    inputs = spark.createDataFrame([(1, "x"), (2, "y")], "example_id long, input string")
    same = spark.createDataFrame([(1, "x"), (2, "y")], "example_id long, source string")
    align.check_alignment(same, inputs)
    with pytest.raises(ValueError):
        align.check_alignment(spark.createDataFrame([(1, "x")], "example_id long, source string"), inputs)


def fold(rows, window=3):
    """(run, pos, source, prediction) rows through the rule, one by one."""
    kept, state = [], {}
    for run, pos, source, prediction in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        recent = state.setdefault(run, [])
        if source not in recent:
            kept.append(prediction)
            recent.append(source)
            del recent[:-window]
    return sorted(kept)


def dedup_rows(seed=11):
    import random
    rng = random.Random(seed)
    rows = []
    for run, letters in ((0, "ab"), (1, "abc"), (2, "abcd"), (3, "abcdefgh"), (None, "abcde")):
        for i in range(800):
            rows.append((run, i, rng.choice(letters), f"{run}-{i}"))
    rows += [(9, i, [None, "z", "y", "x", "w"][i * i % 5], f"9-{i}") for i in range(300)]
    return rows


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_dedup_equals_the_sequential_rule(spark, parts):
    rows = dedup_rows()
    df = spark.createDataFrame(rows, "run long, pos long, source string, prediction string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        assert sorted(r.prediction for r in align.dedup_recent_sources(df).collect()) == fold(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_dedup_of_one_long_run(spark):
    import random
    rng = random.Random(2)
    for letters in ("ab", "abc", "abcde"):
        rows = [(1, i, rng.choice(letters), str(i)) for i in range(60_000)]
        df = spark.createDataFrame(rows, "run long, pos long, source string, prediction string")
        assert sorted(r.prediction for r in align.dedup_recent_sources(df).collect()) == fold(rows)
    assert align.dedup_recent_sources(df.limit(0)).collect() == []

"""Sources, sinks and incremental scoring: round trips through fresh temp dirs."""
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexeval.sources import io
from lexeval.streaming.incremental import score_new_outputs


def test_csv_source_quotes_newlines_blanks(spark, tmp):
    p = os.path.join(tmp, "validation.csv")
    with open(p, "w") as f:
        f.write('input,target\n"a, ""quoted""","line1\nline2"\nNA,\nx,y\n')
    df = io.load_custom_dataset(spark, validation_file=p).orderBy("example_id").collect()
    assert df[0].input == 'a, "quoted"' and df[0].target == "line1\nline2"
    assert df[1].input == "NA" and df[1].target is None
    assert {r.split for r in df} == {"validation"}


def test_json_and_csv_splits_read_by_own_suffix(spark, tmp):
    j = os.path.join(tmp, "train.json")
    c = os.path.join(tmp, "test.csv")
    pd.DataFrame({"input": ["i1"], "target": ["t1"]}).to_json(j, orient="records", lines=True)
    pd.DataFrame({"input": ["i2"], "target": ["t2"], "extra": [1]}).to_csv(c, index=False)
    df = io.load_custom_dataset(spark, train_file=j, test_file=c)
    got = {r.split: (r.input, r.target) for r in df.collect()}
    assert got == {"train": ("i1", "t1"), "test": ("i2", "t2")}


def test_extension_check():
    with pytest.raises(ValueError):
        io.check_files({"train": "x.txt"})
    with pytest.raises(ValueError):
        io.check_files({"train": None})
    assert io.check_files({"test": "x.json"}) == {"test": "x.json"}


def test_outputs_dir_both_dialects(spark, tmp):
    pd.DataFrame({"source": ["s1", "s2"], "prediction": ["p1", None]}).to_csv(
        os.path.join(tmp, "outputs_validation_1145.csv"), index=False)
    pd.DataFrame({"sources": ["s1"], "prediction": ["q1"]}).to_csv(os.path.join(tmp, "outputs_eval-20.csv"), index=False)
    pd.DataFrame({"x": [1]}).to_csv(os.path.join(tmp, "results_validation_1.csv"), index=False)
    df = io.read_outputs(spark, tmp)
    got = sorted((r.step, r.source, r.prediction) for r in df.collect())
    assert got == [(20, "s1", "q1"), (1145, "s1", "p1"), (1145, "s2", "")]


def test_sinks_and_overwrite_guard(spark, tmp):
    df = spark.createDataFrame([("r", 1, 0, ["a", "b"], 1.0)],
                               "run string, step int, example_id long, references array<string>, score double")
    out = os.path.join(tmp, "outputs")
    io.write_results(df, out, fmt="csv")
    back = spark.read.options(**io.CSV_OPTIONS).csv(out).first()
    assert back.references == '["a","b"]'
    with pytest.raises(Exception):
        io.write_results(df, out, fmt="csv")  # errorifexists
    with pytest.raises(ValueError):
        io.write_results(df, out, fmt="csv", mode="overwrite", inputs=[out + "/run=r"])
    assert io.heavy_paths("o/outputs_eval-5.csv") == ("o/outputs_eval-5_heavy_overall.csv",
                                                      "o/outputs_eval-5_heavy_scores.csv")


def test_dataset_partition_pruning(spark, tmp):
    df = spark.createDataFrame([(1, "train", "a"), (2, "validation", "b")], "example_id long, split string, input string")
    path = os.path.join(tmp, "ds")
    io.write_dataset(df, path)
    got = io.load_dataset(spark, path, split="validation")
    assert [r.input for r in got.collect()] == ["b"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "validation" in plan


def test_ids_are_dense_over_input_splits(spark, tmp):
    p = os.path.join(tmp, "train.json")
    pd.DataFrame({"input": [f"row {i} " + "x" * 200 for i in range(2000)], "target": "t"}).to_json(p, orient="records", lines=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        df = io.load_custom_dataset(spark, train_file=p, validation_file=p)
        assert df.rdd.getNumPartitions() > 4
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({(r.split, r.example_id) for r in rows}) == 4000
    assert all(r.input.startswith(f"row {r.example_id} ") for r in rows)


def test_files_of_different_columns_side_by_side(spark, tmp):
    pd.DataFrame({"source": ["s0", "s1"], "prediction": ["p0", "p1"], "reference": ['["a"]', '["b"]'], "score": [1, 2]}).to_csv(
        os.path.join(tmp, "outputs_validation_10.csv"), index=False)
    pd.DataFrame({"prediction": ["q0", "q0", "q1"], "sources": ["s0", "s0", "s1"]}).to_csv(
        os.path.join(tmp, "outputs_eval-20.csv"), index=False)
    rows = sorted((r.step, r.pos, r.source, r.prediction, r.references, r.older) for r in io.read_outputs(spark, tmp).collect())
    assert rows == [(10, 0, "s0", "p0", ["a"], False), (10, 1, "s1", "p1", ["b"], False), (20, 0, "s0", "q0", None, True),
                    (20, 1, "s0", "q0", None, True), (20, 2, "s1", "q1", None, True)]


def _dataset(spark):
    return spark.createDataFrame([(0, "s0", ["a b c d"]), (1, "s1", ["e f g h"])], "example_id long, input string, references array<string>")


def test_post_hoc_scoring_guards_its_input(spark, tmp):
    from lexeval.plans.posthoc import evaluate_outputs
    pd.DataFrame({"sources": ["s0", "s0", "s1"], "prediction": ["a b c d", "x", "e f g h"]}).to_csv(
        os.path.join(tmp, "outputs_eval-20.csv"), index=False)
    assert [(r.step, round(r.BLEU, 6)) for r in evaluate_outputs(spark, tmp, _dataset(spark), ["BLEU"]).collect()] == [(20, 100.0)]
    for bad in (["s1", "s0"], ["s0"], ["s0", None]):
        pd.DataFrame({"source": bad, "prediction": ["x"] * len(bad)}).to_csv(os.path.join(tmp, "outputs_validation_5.csv"), index=False)
        with pytest.raises(ValueError):
            evaluate_outputs(spark, tmp, _dataset(spark), ["BLEU"])


def test_incremental_scoring_available_now(spark, tmp):
    outdir = os.path.join(tmp, "outs")
    os.makedirs(outdir)
    summary, log, ckpt = (os.path.join(tmp, x) for x in ("summary", "log", "ckpt"))

    def write_step(step, preds, sources=("s0", "s1")):
        pd.DataFrame({"source": list(sources), "prediction": preds, "reference": ['["a"]'] * 2}).to_csv(
            os.path.join(outdir, f"outputs_validation_{step}.csv"), index=False)

    def run():
        q = score_new_outputs(spark, outdir, _dataset(spark), summary, ckpt, run="r1", metrics=["BLEU", "chrF++"], log_path=log)
        q.awaitTermination()
        return spark.read.parquet(summary)

    write_step(10, ["a b c d", "e f g h"])
    first = run()
    assert [(r.step, round(r.BLEU, 6)) for r in first.collect()] == [(10, 100.0)]
    again = run()  # nothing new: nothing changes
    assert again.count() == 1
    write_step(20, ["a b x d", "e f g h"])
    third = run()
    assert sorted(r.step for r in third.collect()) == [10, 20]
    assert spark.read.parquet(log).count() == 4
    write_step(30, ["a", "b"], ("s1", "s0"))
    with pytest.raises(Exception, match="do not belong"):
        run()


def test_overwriting_a_folder_that_is_read_is_refused(spark, tmp):
    path = os.path.join(tmp, "table")
    spark.range(3).withColumn("step", F.lit(1)).write.parquet(path)
    df = spark.read.parquet(path)
    for target in (path, path + "/step=1", tmp):
        with pytest.raises(ValueError):
            io.write_results(df, target, mode="overwrite")


def test_heavy_tables(spark, tmp):
    per = spark.createDataFrame([(1, 0, 0.5)], "step int, example_id long, score double")
    io.write_heavy(per.drop("example_id"), per, os.path.join(tmp, "outputs_eval-1.csv"))
    assert spark.read.options(**io.CSV_OPTIONS).csv(os.path.join(tmp, "outputs_eval-1_heavy_scores.csv")).count() == 1


def test_metric_log_append_and_registry(spark, tmp):
    from lexeval.plans import evaluate as EV
    pairs = spark.createDataFrame([(1, 0, "a b c d", ["a b c d"]), (2, 0, "a b", ["a b c d"])],
                                  "step int, example_id long, prediction string, references array<string>")
    EV.register_metric("n_rows", lambda p, k, n: p.groupBy(*k).agg(F.count("*").cast("double").alias(n)))
    wide = EV.evaluate(pairs, ["step"], ["BLEU", "n_rows"])
    path = os.path.join(tmp, "log")
    io.append_metric_log(wide, path, ["step"], ["BLEU", "n_rows"])
    io.append_metric_log(wide, path, ["step"], ["BLEU", "n_rows"])
    got = spark.read.parquet(path)
    assert got.count() == 4 and {r.metric for r in got.collect()} == {"eval/BLEU", "eval/n_rows"}
    with pytest.raises(KeyError):
        EV.evaluate(pairs, ["step"], ["NOPE"])


def test_tuple_predictions_and_batched_row_function(spark):
    from lexeval.operators import tokens
    from lexeval.operators.rowfn import map_batches
    df = spark.createDataFrame([((["x"], [1]),)], "p struct<ids:array<string>,scores:array<int>>")
    assert tokens.first_of_tuple(df, "p").first().p == ["x"]
    nums = spark.range(10)
    out = map_batches(nums, lambda pdf: pdf.assign(id=pdf["id"] * 2), "id long")
    assert sorted(r.id for r in out.collect()) == list(range(0, 20, 2))


def test_positions_follow_the_part_files(spark, tmp):
    """Parts of unequal size, read by tasks in any order."""
    rows = [(i, f"s{i}", f"p{i} " + "x" * (i % 7 * 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "example_id long, source string, prediction string").repartition(5)
    io.write_outputs(df, tmp, 3, parts=7)
    io.write_outputs(df.withColumnRenamed("source", "sources"), tmp, 4, older=True, parts=3)
    assert len([f for f in os.listdir(os.path.join(tmp, "outputs_validation_3.csv")) if f.startswith("part-")]) == 7
    got = io.read_outputs(spark, tmp)
    assert got.select("path").distinct().count() == 2
    assert sorted((r.step, r.pos, r.source, r.prediction) for r in got.collect()) == sorted((s, i, a, b) for s in (3, 4) for i, a, b in rows)


def test_part_numbers_order_by_value(spark, tmp):
    folder = os.path.join(tmp, "outputs_validation_1.csv")
    os.makedirs(folder)
    for k, part in enumerate(("part-00002-x", "part-99999-x", "part-100000-x")):
        pd.DataFrame({"source": [f"s{k}"], "prediction": ["p"]}).to_csv(os.path.join(folder, part + ".csv"), index=False)
    assert [(r.pos, r.source) for r in io.read_outputs(spark, tmp).orderBy("pos").collect()] == [(0, "s0"), (1, "s1"), (2, "s2")]


def test_json_folder_keeps_its_order(spark, tmp):
    df = spark.range(300).select(F.col("id").alias("example_id"), F.format_string("row %d", "id").alias("input"))
    io.write_ordered(df.repartition(4), os.path.join(tmp, "train.json"), "example_id", 6)
    got = io.load_custom_dataset(spark, train_file=os.path.join(tmp, "train.json"))
    assert all(r.input == f"row {r.example_id}" for r in got.collect()) and got.count() == 300


def test_fingerprints_find_one_changed_row(spark):
    from lexeval.plans.posthoc import differing_rows
    n = 1000
    data = spark.range(n).select(F.col("id").alias("example_id"), F.when(F.col("id") % 9 != 0, F.format_string("t%d", "id")).alias("input"))
    def file(name, **change):
        return data.select(F.lit(name).alias("path"), "example_id", F.coalesce(*[F.when(F.col("example_id") == int(k[1:]), F.lit(v)) for k, v in change.items()], F.col("input")).alias("source"))
    clean, one = file("clean", _5="t5"), file("one", _5="other")
    swapped = file("swapped", _1="t2", _2="t1")
    lost = file("lost", _5="t5").where("example_id <> 7")
    null = file("null", _9="")
    got = differing_rows(clean.union(one).union(swapped).union(lost).union(null), data, span=64).collect()
    assert sorted((r.path, r.example_id, r.expected, r.got) for r in got) == [
        ("lost", 7, "t7", None), ("null", 9, None, ""), ("one", 5, "t5", "other"), ("swapped", 1, "t1", "t2"), ("swapped", 2, "t2", "t1")]


def test_a_clean_run_shuffles_no_text(spark):
    from lexeval.plans.posthoc import fingerprints
    data = spark.range(100).select(F.col("id").alias("example_id"), F.lit("a text").alias("input"))
    plan = fingerprints(data, "input")._jdf.queryExecution().executedPlan().toString()
    exchange = [x for x in plan.split("\n") if "partial_bit_xor" in x]
    assert exchange and plan.index("Exchange") < plan.index("partial_bit_xor")  # texts become numbers before they move

"""Reference tables: the same scores, no second tokenisation, no exchange."""

import pytest
from pyspark.sql import functions as F

from lexeval.metrics import fused, shared
from lexeval.plans import evaluate as EV


@pytest.fixture(scope="module")
def data(spark):
    refs = spark.createDataFrame([(0, ["a b c d", "a b x d"]), (1, ["the cat sat on the mat."]), (2, []), (3, [""]), (4, None)],
                                 "example_id long, references array<string>")
    preds = spark.createDataFrame([(s, i, t) for s in (1, 2) for i, t in enumerate(["a b c d"[:3 * s], "The cat, the mat", "x", "", "y", "beyond"])],
                                  "step int, example_id long, prediction string")
    shared.write_reference_table(refs, "refs_of_test", buckets=4, mode="overwrite")
    return refs, preds


def test_scores_equal_those_of_aligned_rows(spark, data):
    refs, preds = data
    want = EV.evaluate(preds.join(refs, "example_id", "left"), ["step"], list(fused.FUSABLE)).orderBy("step").collect()
    got = shared.evaluate_against(spark, preds, "refs_of_test").orderBy("step").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want] and len(got) == 2
    one = lambda df: sorted((r.step, r.example_id, r.chrf, r.meteor) for r in df.collect())
    assert str(one(shared.per_example_against(spark, preds, "refs_of_test"))) == str(one(EV.per_example(preds.join(refs, "example_id", "left"), ["step"])))


def test_the_reference_side_has_no_exchange_and_no_tokenizer(spark, data):
    _, preds = data
    for run in (preds.where("step = 1"), preds.where("step = 2")):
        plan = shared.evaluate_against(spark, run, "refs_of_test", metrics=["BLEU", "rougeL"])._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):].split("\n")
        scan = next(i for i, line in enumerate(join) if "FileScan parquet" in line)
        side = join[next(i for i in range(scan, 0, -1) if "Exchange" in join[i] or "Scan ExistingRDD" in join[i]) + 1:scan + 1]
        assert "Bucketed: true" in join[scan] and not any("Exchange" in line for line in side)
        assert "regexp" not in " ".join(side) and "_ref_mr" not in join[scan]  # only the tokens that are asked for


def test_a_table_for_other_metrics_is_refused(spark, data):
    refs, preds = data
    shared.write_reference_table(refs, "refs_bleu_only", ["BLEU"], buckets=2, mode="overwrite")
    assert shared.evaluate_against(spark, preds, "refs_bleu_only", metrics=["BLEU"]).count() == 2
    with pytest.raises(ValueError, match="other metrics"):
        shared.evaluate_against(spark, preds, "refs_bleu_only", metrics=["meteor"])
    with pytest.raises(KeyError):
        shared.write_reference_table(refs, "refs_none", ["nothing"])


def test_rows_of_one_bucket_lie_in_one_file(spark, data):
    files = spark.table("refs_of_test").select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert files <= 4

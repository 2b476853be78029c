"""Settings, aggregators, bootstrap and the score store against plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexeval.metrics import bootstrap as B
from lexeval.metrics import fused, ngram, sequence
from lexeval.metrics.aggregators import GROUPS, aggregate
from lexeval.plans import evaluate as EV
from lexeval.plans import rescore
from lexeval.plans.stat_queries import Coverage, WordsQuantile
from lexeval.sources import io

PHRASES = ["the cat sat on the mat", "A cat, on a mat!", "", "one two three four five", "two three", "Straße in Brünn", None]


@pytest.fixture(scope="module")
def pairs(spark):
    refs = lambda i: [[], None, [PHRASES[i % 7]], [PHRASES[(i + k) % 6] for k in range(1 + i % 3)], [""]][i % 5]
    rows = [(s, i, PHRASES[(i * (s or 3)) % 7], refs(i)) for s in (1, 2, None) for i in range(40)]
    return spark.createDataFrame(rows, "step int, example_id long, prediction string, references array<string>").repartition(5).persist()


def by_step(df):
    return {r["step"]: r.asDict() for r in df.collect()}


def near(a, b):
    return a is None and b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_settings_in_one_pass_equal_the_families_alone(pairs):
    asked = {"b2": ("BLEU", {"max_order": 2}), "bl": ("BLEU", {"lowercase": True}), "BLEU": None, "chrF": ("chrF++", {"word_order": 0}),
             "c3": ("chrF++", {"char_order": 3, "word_order": 1, "beta": 1.0}), "m": ("meteor", {"gamma": 0.1}), "meteor": {}}
    got = by_step(EV.evaluate(pairs, ["step"], asked))
    alone = [ngram.corpus_bleu(pairs, ["step"], False, "b2", 2), ngram.corpus_bleu(pairs, ["step"], True, "bl"), ngram.corpus_bleu(pairs, ["step"], False, "BLEU"),
             ngram.corpus_chrf(pairs, ["step"], 6, 0, name="chrF"), ngram.corpus_chrf(pairs, ["step"], 3, 1, 1.0, name="c3"), sequence.meteor(pairs, ["step"])]
    for df in alone:
        name = df.columns[-1]
        for step, row in by_step(df).items():
            assert near(got[step][name], row[name]), (step, name)
    assert got.keys() == {1, 2, None} and got[1]["m"] > got[1]["meteor"] and got[1]["chrF"] != got[1]["c3"]


def test_strange_settings_are_refused(pairs):
    for what in ({"BLEU": {"order": 2}}, {"BLEU": {"max_order": 5}}, {"chrF++": {"word_order": 3}}):
        with pytest.raises(ValueError):
            EV.evaluate(pairs, ["step"], what)
    with pytest.raises(KeyError):
        EV.evaluate(pairs, ["step"], {"x": "unheard of"})
    with pytest.raises(ValueError, match="twice"):
        EV.evaluate(pairs, ["step"], ["BLEU", "BLEU"])


def test_aggregators_equal_a_fold_over_all_rows(pairs):
    todo = {"median": WordsQuantile(), "most": WordsQuantile(1.0), "coverage": Coverage()}
    got = by_step(aggregate(pairs, ["step"], todo))
    rows = pairs.toPandas()
    for step in (1, 2, None):
        part = rows[rows["step"].isna() if step is None else rows["step"] == step]
        for label, a in todo.items():
            assert near(got[step][label], a.finish(a.update(a.zero(), part))), (step, label)
    whole = aggregate(pairs, [], todo).collect()
    assert len(whole) == 1 and whole[0]["most"] == 6
    none = aggregate(pairs.where("false"), [], todo).collect()
    assert [tuple(r) for r in none] == [(None, None, None)] and aggregate(pairs.where("false"), ["step"], todo).count() == 0


def test_many_groups_leave_a_task_early(spark):
    n = 3 * GROUPS
    rows = spark.range(0, 2 * n, 1, 2).select((F.col("id") % n).alias("step"), F.lit("a b").alias("prediction"))
    out = aggregate(rows, ["step"], {"q": WordsQuantile()})
    assert out.agg(F.count("*"), F.min("q"), F.max("q")).collect()[0] == (n, 2.0, 2.0)


def test_weights_are_poisson_and_of_the_id_alone():
    ids = np.array([0, 1, 2, 1 << 40, -5, *range(100, 20_000)])
    w = B.weights(ids, 50)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert abs((w[:, 1:] == 0).mean() - math.exp(-1)) < 0.005
    assert (B.weights(ids[::-1], 50)[::-1] == w).all() and (B.weights(ids, 50, seed=1) != w).any()
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.03 and abs(np.corrcoef(w[1:, 1], w[:-1, 1])[0, 1]) < 0.03


def test_a_replicate_is_the_score_of_the_repeated_rows(spark, pairs):
    """Each example as often as its weight, scored as a corpus of its own."""
    names = list(fused.FUSABLE)
    got = B.replicate_scores(pairs, ["step"], names, 3).collect()
    drawn = B.weights(np.arange(40), 3)
    for k in range(4):
        times = spark.createDataFrame([(i, int(drawn[i, k])) for i in range(40)], "example_id long, n int")
        again = pairs.join(times, "example_id").where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
        want = by_step(EV.evaluate(again, ["step"], names))
        for r in got:
            if r["replicate"] == k:
                assert all(near(r[m], want[r["step"]][m]) for m in names), (k, r, want[r["step"]])
    assert len(got) == 12


def test_intervals_and_paired_comparison(spark):
    rows = [(s, i, "a b c d" if (i % 4 or s == 2) else "x", ["a b c d"]) for s in (1, 2, 3) for i in range(60)]
    pairs = spark.createDataFrame(rows, "step int, example_id long, prediction string, references array<string>")
    out = {r["step"]: r for r in B.bootstrap(pairs, ["step"], ["rougeL"], 100, step="step").collect()}
    assert out[1]["score"] == 0.75 and out[1]["low"] < 0.75 < out[1]["high"] and out[1]["wins"] is None
    assert out[2]["low"] == out[2]["high"] == 1.0 and out[2]["wins"] == 1.0 and out[3]["wins"] == 0.0
    narrow = {r["step"]: r for r in B.bootstrap(pairs, ["step"], ["rougeL"], 100, level=0.5).collect()}
    assert narrow[1]["high"] - narrow[1]["low"] < out[1]["high"] - out[1]["low"]
    with pytest.raises(ValueError):
        B.replicate_scores(pairs, ["step"], ["rougeL"], 0)


def test_the_score_store_follows_the_directory(spark, tmp):
    data = spark.createDataFrame([(i, f"in {i}", [f"the cat {i} sat", "a mat"]) for i in range(6)], "example_id long, input string, references array<string>")
    folder, store, names = tmp + "/out", tmp + "/store", ["BLEU", "rougeL", "TER"]

    def write(step, texts, mode="errorifexists"):
        rows = spark.createDataFrame([(i, f"in {i}", t) for i, t in enumerate(texts)], "example_id long, source string, prediction string")
        io.write_outputs(rows, folder, step, parts=2, mode=mode)

    def expected(steps):
        rows = [(s, i, t) for s, texts in steps.items() for i, t in enumerate(texts)]
        p = spark.createDataFrame(rows, "step int, example_id long, prediction string").join(data, "example_id")
        return {s: [r[m] for m in names] for s, r in by_step(EV.evaluate(p, ["step"], names)).items()}

    def now():
        return {s: [r[m] for m in names] for s, r in by_step(rescore.summary(spark, store, names)).items()}

    def same(a, b):
        return a.keys() == b.keys() and all(near(x, y) for s in a for x, y in zip(a[s], b[s]))

    one, two, three = [[f"the cat {i} {w}" for i in range(6)] for w in ("sat", "ran", "sat down")]
    with pytest.raises(ValueError, match="no store"):
        rescore.summary(spark, store, names)
    write(1, one), write(2, two)
    assert rescore.update(spark, folder, data, store, names) == {"scored": 2, "kept": 0, "dropped": 0}
    assert rescore.update(spark, folder, data, store, names) == {"scored": 0, "kept": 2, "dropped": 0}
    assert same(now(), expected({1: one, 2: two}))
    write(2, three, "overwrite"), write(3, two)  # rewritten in place, and a late one
    assert rescore.update(spark, folder, data, store, names) == {"scored": 2, "kept": 1, "dropped": 0}
    assert same(now(), expected({1: one, 2: three, 3: two}))
    write(3, two, "overwrite")  # the same rows again: the sums are kept
    assert rescore.update(spark, folder, data, store, names) == {"scored": 0, "kept": 3, "dropped": 0}
    assert rescore.update(spark, folder, data, store, names, pattern="outputs_validation_[13].csv") == {"scored": 0, "kept": 2, "dropped": 1}
    assert same(now(), expected({1: one, 3: two}))
    # an update that died leaves the last complete generation
    spark.range(3).write.parquet(store + "/generation-99/part")
    assert same(now(), expected({1: one, 3: two}))
    with pytest.raises(ValueError, match="other metrics"):
        rescore.update(spark, folder, data, store, ["BLEU"])
    write(4, one[:3])  # too few rows: refused, the store stays
    with pytest.raises(ValueError, match="other than 6 rows"):
        rescore.update(spark, folder, data, store, names)
    assert same(now(), expected({1: one, 3: two}))

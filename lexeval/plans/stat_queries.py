"""Registered queries of metrics with settings, user aggregators, bootstrap
intervals and the score store, with their SQL twins."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from lexeval.metrics import bootstrap as B
from lexeval.plans import evaluate as EV
from lexeval.plans import oracle as O
from lexeval.plans import rescore
from lexeval.plans import sql_views as S
from lexeval.plans import views as V
from lexeval.plans.file_queries import PARTS, written_dataset
from lexeval.plans.oracle import ORACLE
from lexeval.plans.queries import KEYS, SUMMARY, L, query, r6
from lexeval.plans.sql_views import with_views
from lexeval.session import scratch_path
from lexeval.sources import io

# ------------------------------------------------------------ U2: settings
SETTINGS = {"bleu": "BLEU", "bleu2_lower": ("BLEU", {"max_order": 2, "lowercase": True}),
            "chrf": ("chrF++", {"word_order": 0}), "chrf_1": ("chrF++", {"word_order": 1, "beta": 1})}


@query("metric_settings")
def q_settings(spark, sf_dir):
    """Metrics asked for several times, each with settings of its own, in one pass."""
    w = EV.evaluate(V.eval_pairs(spark, sf_dir), KEYS, SETTINGS)
    return w.select(L("step").alias("step"), *[r6(F.col(m), m) for m in SETTINGS])


ORACLE["metric_settings"] = f"""
SELECT step::BIGINT AS step, bleu, bleu2_lower, chrf, chrf_1 FROM ({ORACLE["bleu"]}) JOIN ({O._bleu_sql(True, "bleu2_lower", 2)}) USING (step)
JOIN ({O._chrf_sql("chrf", 0)}) USING (step) JOIN ({O._chrf_sql("chrf_1", 1, 1)}) USING (step)"""


# ------------------------------------------------------------ U2: aggregators
class WordsQuantile:
    """The smallest number of words that a share ``q`` of the predictions does not
    exceed.  Its state counts predictions by number of words."""

    columns = ("prediction",)

    def __init__(self, q: float = 0.5):
        self.q = q

    def zero(self):
        return {}

    def update(self, state, rows: pd.DataFrame):
        found = rows["prediction"].dropna().str.split().str.len().value_counts()
        return self.merge(state, {int(n): int(c) for n, c in found.items()})

    def merge(self, left, right):
        return {n: left.get(n, 0) + right.get(n, 0) for n in {*left, *right}}

    def finish(self, state):
        rank = math.ceil(self.q * sum(state.values()))
        for n in sorted(state):
            rank -= state[n]
            if rank <= 0:
                return n
        return None


class Coverage:
    """The share of the predictions' words, once each, that a reference has."""

    columns = ("prediction", "references")

    def zero(self):
        return (0, 0)

    def update(self, state, rows: pd.DataFrame):
        found, total = state
        for text, refs in zip(rows["prediction"], rows["references"]):
            words = set((text or "").split())
            known = {w for r in (refs if refs is not None else ()) for w in (r or "").split()}
            found, total = found + len(words & known), total + len(words)
        return found, total

    def merge(self, left, right):
        return left[0] + right[0], left[1] + right[1]

    def finish(self, state):
        return state[0] / state[1] if state[1] else None


@query("user_aggregators")
def q_aggregators(spark, sf_dir):
    """Two aggregators written by a user, one of them with two settings,
    beside a built-in metric."""
    EV.register_aggregator("words_quantile", WordsQuantile)
    EV.register_aggregator("coverage", Coverage)
    w = EV.evaluate(V.eval_pairs(spark, sf_dir), KEYS, {"median_words": "words_quantile", "long_words": ("words_quantile", {"q": 0.9}),
                                                        "coverage": None, "word_edit_rate": None})
    return w.select(L("step").alias("step"), *[r6(F.col(m), m) for m in ("median_words", "long_words", "coverage", "word_edit_rate")])


ORACLE["user_aggregators"] = with_views(["eval_pairs"], f"""
SELECT step, median_words, long_words, coverage, word_edit_rate FROM ({O.WORD_EDIT_RATE})
JOIN (SELECT step::BIGINT AS step, min(n) FILTER (k >= ceil(0.5::DOUBLE * total))::DOUBLE AS median_words,
             min(n) FILTER (k >= ceil(0.9::DOUBLE * total))::DOUBLE AS long_words
      FROM (SELECT step, n, row_number() OVER (PARTITION BY step ORDER BY n) AS k, count(*) OVER (PARTITION BY step) AS total
            FROM (SELECT step, len({S.words("prediction")}) AS n FROM eval_pairs WHERE prediction IS NOT NULL)) GROUP BY step) USING (step)
JOIN (SELECT step::BIGINT AS step, round(sum(len(list_filter(w, lambda x: list_contains(r, x)))) / nullif(sum(len(w)), 0), 6) AS coverage
      FROM (SELECT step, list_distinct({S.words("coalesce(prediction, '')")}) AS w,
                   flatten(list_transform(list_filter(coalesce("references", []), lambda x: x IS NOT NULL), lambda x: {S.words("x")})) AS r
            FROM eval_pairs) GROUP BY step) USING (step)""")

# ------------------------------------------------------------ M5: bootstrap
REPLICATES = 200
RESAMPLED = ["rougeL", "word_edit_rate"]


@query("bootstrap_scores")
def q_bootstrap(spark, sf_dir):
    """M5: scores with 95 % intervals and the paired comparison of each step with
    the one before it."""
    b = B.bootstrap(V.eval_pairs(spark, sf_dir), KEYS, RESAMPLED, REPLICATES, step="step")
    return b.select(L("step").alias("step"), "metric", *[r6(F.col(c), c) for c in ("score", "low", "middle", "high", "wins")])


def _replace(rows: str, **columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in columns.items())}) FROM ({rows})"


def _mixed(rows: str) -> str:
    """The 32-bit hash of column ``x``."""
    for _ in range(2):
        rows = _replace(rows, x=f"(xor(x >> 16, x) * {B.MIX}) & 4294967295")
    return _replace(rows, x="xor(x >> 16, x)")


_IDS = _replace(_mixed("SELECT DISTINCT example_id, example_id::BIGINT & 4294967295 AS x FROM eval_pairs"), x="xor(x, example_id::BIGINT >> 32)")
_DRAWN = _mixed(f"SELECT example_id, k, (x + k * {B.STRIDE}) & 4294967295 AS x FROM ({_mixed(_IDS)}), (SELECT unnest(range(1, {REPLICATES + 1})) AS k)")

ORACLE["bootstrap_scores"] = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, metric, round(max(v) FILTER (k = 0), 6) AS score, round(quantile_cont(v, 0.025) FILTER (k > 0), 6) AS low,
       round(quantile_cont(v, 0.5) FILTER (k > 0), 6) AS middle, round(quantile_cont(v, 0.975) FILTER (k > 0), 6) AS high,
       round(avg(CASE WHEN v > before THEN 1.0 WHEN v = before THEN 0.5 WHEN v < before THEN 0.0 END) FILTER (k > 0), 6) AS wins
FROM (SELECT *, lag(v) OVER (PARTITION BY metric, k ORDER BY step) AS before FROM scores) GROUP BY step, metric""", extra=[
    ("weights", f"SELECT example_id, 0 AS k, 1 AS w FROM eval_pairs GROUP BY 1 UNION ALL SELECT example_id, k, {' + '.join(f'(x >= {s})::INT' for s in B.STEPS)} AS w FROM ({_DRAWN})"),
    ("scores", f"""
SELECT step, k, 'rougeL' AS metric, CASE WHEN sum(w) > 0 THEN sum(w * f) / sum(w) END AS v FROM ({O.ROUGE_EACH}) JOIN weights USING (example_id) GROUP BY ALL
UNION ALL
SELECT step, k, 'word_edit_rate' AS metric, CASE WHEN sum(w) = 0 THEN NULL WHEN sum(w * rl) > 0 THEN 100.0 * sum(w * e) / sum(w * rl)
       WHEN sum(w * e) > 0 THEN 100.0 ELSE 0.0 END AS v FROM ({O.EDIT_EACH}) JOIN weights USING (example_id) GROUP BY ALL""")])


# ------------------------------------------------------------ R1: the score store
@query("rescored_summary")
def q_rescored(spark, sf_dir):
    """A store of sums brought up to date three times: steps 1 and 2 with
    predictions of another step in one of them, then that file rewritten in place,
    then step 3 arriving late."""
    folder, store = scratch_path(spark, "rewritten"), scratch_path(spark, "score-store")
    dataset = written_dataset(spark, sf_dir)
    rows = V.eval_preds(spark, sf_dir).join(V.eval_refs(spark, sf_dir), "example_id").select("step", "example_id", "source", "prediction")
    of = lambda s: rows.where(F.col("step") == s).drop("step")
    for step, shown in ((1, 1), (2, 3)):
        io.write_outputs(of(shown), folder, step, parts=PARTS)
    rescore.update(spark, folder, dataset, store, SUMMARY)
    io.write_outputs(of(2), folder, 2, parts=PARTS, mode="overwrite")
    rescore.update(spark, folder, dataset, store, SUMMARY)
    io.write_outputs(of(3), folder, 3, parts=PARTS)
    rescore.update(spark, folder, dataset, store, SUMMARY)
    return rescore.summary(spark, store, SUMMARY).select(L("step").alias("step"), *[r6(F.col(m), m) for m in SUMMARY])


ORACLE["rescored_summary"] = ORACLE["summary_wide"]

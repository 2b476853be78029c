"""Evaluation driver: metric registry (U2), light/heavy selection (M12),
wide summary per group (S8), long step-keyed metric log (S10), per-example
table (M13 / P12) and scoring from generated ids (U3).

``evaluate(pairs, keys, metrics)`` plans only the selected metric families;
each family is one narrow pass over the aligned rows plus a tiny aggregation,
and the per-group results (one row per group each) are joined on the keys.
Every metric may be asked for several times with settings of its own, and a
user may add metrics as DataFrame functions (:func:`register_metric`) or as
aggregators (:func:`register_aggregator`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeval.metrics import ngram, sequence
from lexeval.metrics.aggregators import Aggregator, aggregate
from lexeval.metrics.fused import FUSABLE, evaluate_fused, per_example_fused, specs_of
from lexeval.operators import tokens

MetricFn = Callable[..., DataFrame]

METRICS: dict[str, MetricFn] = {}
AGGREGATORS: dict[str, Callable[..., Aggregator]] = {}


def register_metric(name: str, fn: MetricFn) -> None:
    """Add a metric: ``fn(pairs, keys, name, **settings) -> DataFrame(keys..., name)``."""
    AGGREGATORS.pop(name, None)
    METRICS[name] = fn


def register_aggregator(name: str, make: Callable[..., Aggregator]) -> None:
    """Add a metric as an aggregator: ``make(**settings)``.  All aggregators of a
    call share one pass over the rows (see ``metrics.aggregators``)."""
    METRICS.pop(name, None)
    AGGREGATORS[name] = make


register_metric("BLEU", lambda p, k, n, **c: ngram.corpus_bleu(p, k, name=n, **{"lowercase": False, **c}))
register_metric("BLEU_lower", lambda p, k, n, **c: ngram.corpus_bleu(p, k, lowercase=True, name=n, **c))
register_metric("chrF++", lambda p, k, n, **c: ngram.corpus_chrf(p, k, name=n, **c))
register_metric("TER", lambda p, k, n: sequence.ter(p, k, name=n))
register_metric("word_edit_rate", lambda p, k, n: sequence.word_edit_rate(p, k, name=n))
register_metric("rougeL", lambda p, k, n: sequence.rouge_l(p, k, name=n))
register_metric("meteor", lambda p, k, n, **c: sequence.meteor(p, k, name=n, **c))

register_metric("gen_len", lambda p, k, n: evaluate_fused(p, k, {n: "gen_len"}))

BUILTIN = dict(METRICS)
LIGHT = ["BLEU", "BLEU_lower", "chrF++", "TER", "rougeL", "meteor"]


def evaluate(pairs: DataFrame, keys: list[str] | tuple = ("step",), metrics=None, fused: bool = True,
             heavy: dict[str, DataFrame] | None = None) -> DataFrame:
    """Wide summary: one row per group, one column per metric.

    ``metrics`` lists names, or maps result columns to settings:
    ``{"BLEU": {}, "chrF": ("chrF++", {"word_order": 0})}`` (see
    ``metrics.fused.SETTINGS``).  The built-in light metrics among them are
    computed in one pass (``metrics.fused``): one projection, one kernel call per
    row, one aggregation.  User aggregators share a second pass.  Other user
    metrics are planned one by one; all are joined on the keys, a row a group.
    ``heavy`` adds families whose per-example scores come from their own tables
    (see :func:`heavy_per_example`): the mean of each score column per group."""
    keys = list(keys)
    specs = specs_of(LIGHT if metrics is None else metrics)
    metrics = [s.label for s in specs]
    if len(set(metrics)) < len(metrics):
        raise ValueError(f"one result column asked for twice: {metrics}")
    unknown = [s.metric for s in specs if s.metric not in METRICS and s.metric not in AGGREGATORS]
    if unknown:
        raise KeyError(f"unknown metrics {unknown}; registered: {sorted([*METRICS, *AGGREGATORS])}")
    built_in = [s for s in specs if fused and s.metric in FUSABLE and METRICS.get(s.metric) is BUILTIN[s.metric]]
    own = [s for s in specs if s.metric in AGGREGATORS]
    parts = [evaluate_fused(pairs, keys, built_in)] if built_in else []
    parts += [aggregate(pairs, keys, {s.label: AGGREGATORS[s.metric](**s.config) for s in own})] if own else []
    parts += [METRICS[s.metric](pairs, keys, s.label, **s.config) for s in specs if s not in built_in and s not in own]
    if heavy:
        parts.append(heavy_summary(heavy_per_example(pairs.select(*keys, "example_id"), heavy, keys), keys))
    one = keys or ["_group"]  # without keys each part is one row
    parts = parts if keys else [p.withColumn("_group", F.lit(1)) for p in parts]
    out = parts[0]
    for p in parts[1:]:  # groups of a NULL key are groups like any other
        p = p.withColumnsRenamed({k: f"__{k}" for k in one})
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in one])
        out = out.join(p, same, "full_outer").withColumns({k: F.coalesce(k, f"__{k}") for k in one}).drop(*[f"__{k}" for k in one])
    return out.drop("_group").select(*keys, *[F.col(f"`{m}`") for m in metrics], *[F.col(f"`{c}`") for c in out.columns if c not in (*one, *metrics)])


def heavy_per_example(examples: DataFrame, heavy: dict[str, DataFrame], keys) -> DataFrame:
    """Per-example scores of the heavy families beside each example of
    ``examples(keys..., example_id)``; an example that a family could not score
    stays, with NULLs.  A family is a table with ``example_id``, those of the
    keys it depends on, score columns and optionally ``scorer``, the version
    that made it: each scorer has columns of its own, so two never mix."""
    out = examples
    for family, scores in heavy.items():
        on = [k for k in (*keys, "example_id") if k in scores.columns]
        values = [c for c in scores.columns if c not in (*on, "scorer")]
        if "scorer" in scores.columns:
            names = sorted(r.scorer for r in scores.select("scorer").distinct().collect())  # a handful of versions
            scores = scores.groupBy(*on).agg(*[F.max(F.when(F.col("scorer") == s, F.col(v))).alias(f"{v}@{s}")
                                               for s in names for v in values])
        out = out.join(scores, on, "left")
    return out


def heavy_summary(per: DataFrame, keys) -> DataFrame:
    keys = list(keys)
    return per.groupBy(*keys).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in per.columns if c not in (*keys, "example_id")])


def metric_log(wide: DataFrame, keys: list[str], metrics: list[str], prefix: str = "eval/") -> DataFrame:
    """Long form ``(keys..., metric, value)`` with the metric-name prefix."""
    long = wide.unpivot(keys, metrics, "metric", "value")
    return long.withColumn("metric", F.concat(F.lit(prefix), F.col("metric")))


def per_example(pairs: DataFrame, keys: list[str], heavy: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per-example rows: source, prediction, references and per-example
    chrF++ and METEOR, computed in one narrow pass that carries the example
    columns (no join back); the scores of heavy families follow."""
    light = per_example_fused(pairs, list(keys))
    return heavy_per_example(light, heavy, list(keys)) if heavy else light


def evaluate_ids(generated: DataFrame, references: DataFrame, vocab: DataFrame, keys=("step",),
                 metrics: list[str] | None = None, ids_col: str = "pred_ids") -> DataFrame:
    """Generated ids → decoded, stripped predictions → metrics, plus
    ``gen_len`` (mean count of non-pad ids).  A prediction whose example has no
    row in ``references`` counts as one without references."""
    keys = list(keys)
    g = tokens.first_of_tuple(generated, ids_col)
    preds = tokens.decode(g, ids_col, vocab, [*keys, "example_id"], "prediction", carry={"_len": tokens.gen_len(F.col(ids_col))})
    pairs = preds.join(references, "example_id", "left")
    wide = evaluate(pairs, keys, [s for s in specs_of(LIGHT if metrics is None else metrics) if s.label != "gen_len"])
    gl = preds.groupBy(*keys).agg(F.avg("_len").alias("gen_len"))
    return wide.join(gl, keys, "full_outer")

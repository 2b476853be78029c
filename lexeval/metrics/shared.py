"""Reference work shared by every step and run that is scored against one
evaluation set.

The references of an evaluation set never change, while a training run is
scored at hundreds of steps.  :func:`write_reference_table` tokenises them once
for every family of metrics and keeps the tokens in a table bucketed and sorted
by ``example_id``.  :func:`evaluate_against` joins predictions to it: only the
predictions move (to the buckets of their examples), the reference side is read
bucket by bucket without an exchange, and no reference is tokenised again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeval.metrics.fused import FUSABLE, evaluate_fused, family_tokens, per_example_fused, reference_columns
from lexeval.session import scratch_path

PREFIX = "_ref_"


def write_reference_table(references: DataFrame, table: str, metrics: list[str] | tuple = FUSABLE, path: str | None = None,
                          buckets: int | None = None, mode: str = "errorifexists") -> None:
    """``references`` (example_id, references and any other columns) with the
    tokens of every family in ``metrics``, as the bucketed table ``table``.
    ``path`` defaults to a new folder below the shared one; ``buckets`` to the
    number of shuffle partitions."""
    spark = references.sparkSession
    sel = frozenset(metrics)
    unknown = sel - set(FUSABLE)
    if unknown:
        raise KeyError(f"no reference tokens for: {sorted(unknown)}")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {n: c for n, c in reference_columns(sel).items() if n in family_tokens(sel)}
    rows = references.select("*", *[c.alias(PREFIX + n) for n, c in wanted.items()])
    # dealt by the bucket's own hash, so that each bucket is one file
    (rows.repartition(buckets, "example_id").write.format("parquet").mode(mode).bucketBy(buckets, "example_id").sortBy("example_id")
     .option("path", path or scratch_path(spark, table)).saveAsTable(table))


def against(spark: SparkSession, predictions: DataFrame, table: str, metrics) -> DataFrame:
    """Aligned rows of ``predictions`` (example_id, prediction, keys) with the
    table's reference tokens for ``metrics``; tokens that the table lacks are an
    error.  An example without a row in the table counts as one without
    references."""
    known = spark.table(table)
    columns = [PREFIX + n for n in sorted(family_tokens(frozenset(metrics)))]
    missing = [c for c in columns if c not in known.columns]
    if missing:
        raise ValueError(f"{table} has no {', '.join(missing)}: it was written for other metrics")
    # not broadcast and not moved: the predictions come to the buckets
    right = known.select("example_id", *[c for c in known.columns if c != "example_id" and c not in predictions.columns and (not c.startswith(PREFIX) or c in columns)])
    rows = predictions.hint("merge").join(right.hint("merge"), "example_id", "left")
    kinds = dict(known.dtypes)
    return rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in columns})


def evaluate_against(spark: SparkSession, predictions: DataFrame, table: str, keys=("step",), metrics: list[str] | None = None) -> DataFrame:
    """The wide summary of ``plans.evaluate.evaluate`` without work on references."""
    metrics = list(FUSABLE if metrics is None else metrics)
    return evaluate_fused(against(spark, predictions, table, metrics), list(keys), metrics)


def per_example_against(spark: SparkSession, predictions: DataFrame, table: str, keys=("step",)) -> DataFrame:
    return per_example_fused(against(spark, predictions, table, ["chrF++", "meteor"]), list(keys))

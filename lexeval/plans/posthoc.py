"""Post-hoc scoring of a directory of outputs files.

Outputs files hold no ids: a row belongs to the example at the same position
of the evaluation split.  Files of the older dialect may repeat rows, which the
window-of-3 rule removes first.  Every file is then matched with the dataset by
dense position and checked: the same number of rows, and the row's source equal
to the example's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeval.operators.align import dedup_recent_sources
from lexeval.plans.evaluate import evaluate, metric_log, per_example
from lexeval.session import scratch_path
from lexeval.sources.io import dense_index, guarded_writer, read_output_files, read_outputs

#: Ids whose texts share one fingerprint.
SPAN = 1 << 16


def positions(outputs: DataFrame) -> DataFrame:
    """Outputs rows with ``example_id`` = dense position in their file, older
    files de-duplicated first."""
    new = outputs.where(~F.col("older")).withColumn("example_id", F.col("pos"))
    old = outputs.where("older")
    if old.isEmpty():
        return new
    old = dedup_recent_sources(old, ("path",), "pos", "source")
    return new.unionByName(dense_index(old, "example_id", ("path",)))


def fingerprints(rows: DataFrame, text: str, keys: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """``(keys..., span, n, f1, f2)``: for each run of ``span`` ids the number of
    rows and a 128-bit fingerprint of which id has which text, whatever order
    the rows come in.  Partial results are combined in each task; no text moves."""
    has = F.col(text).isNotNull()
    return rows.groupBy(*keys, F.floor(F.col("example_id") / span).alias("span")).agg(
        F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "example_id", has, F.col(text))).alias(f"f{k}") for k in (1, 2)])


def differing_rows(outputs: DataFrame, dataset: DataFrame, span: int = SPAN) -> DataFrame:
    """(path, example_id, expected, got) where a file's source is not the
    example's input, or the example or the row is missing in a run of ids that
    the file has.  Texts are joined only for runs whose fingerprints differ."""
    want = fingerprints(dataset, "input", (), span).select("span", *[F.col(c).alias(f"want_{c}") for c in ("n", "f1", "f2")])
    same = [F.col(c).eqNullSafe(F.col(f"want_{c}")) for c in ("n", "f1", "f2")]
    bad = fingerprints(outputs, "source", ("path",), span).join(want, "span", "left").where(~(same[0] & same[1] & same[2])).select("path", "span")
    run = F.floor(F.col("example_id") / span)
    got = outputs.withColumn("span", run).join(bad, ["path", "span"]).select("path", "example_id", F.col("source").alias("got"), F.lit(True).alias("here"))
    expected = dataset.withColumn("span", run).join(bad, "span").select("path", "example_id", F.col("input").alias("expected"), F.lit(True).alias("due"))
    rows = expected.join(got, ["path", "example_id"], "full_outer")
    differ = F.col("here").isNull() | F.col("due").isNull() | ~F.col("expected").eqNullSafe(F.col("got"))
    return rows.where(differ).select("path", "example_id", "expected", "got")


def check_positions(outputs: DataFrame, dataset: DataFrame, limit: int = 5) -> None:
    """Raise where a file has other rows than the dataset: another number of
    rows, or a source that is not the example's input."""
    n = dataset.count()
    sizes = outputs.groupBy("path").count().where(F.col("count") != n).limit(limit).collect()
    if sizes:
        raise ValueError(f"outputs files with other than {n} rows: {[(r.path, r['count']) for r in sizes]}")
    bad = differing_rows(outputs, dataset).limit(limit).collect()
    if bad:
        raise ValueError(f"outputs do not belong to these examples: {bad}")


def aligned_outputs(outputs: DataFrame, dataset: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(step, example_id, source, prediction, references) of checked outputs;
    with ``carry=("path",)`` the file's path as well.
    ``dataset`` is one split: (example_id dense from 0, input, references).  The
    files are parsed once, into a table that the check and the scores read."""
    rows = positions(outputs).select("path", "step", "example_id", "source", "prediction")
    path = scratch_path(rows.sparkSession, "positions")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    check_positions(rows, dataset)
    return rows.drop(*{"path"} - set(carry)).join(dataset.select("example_id", "references"), "example_id")


def evaluate_outputs(spark: SparkSession, directory: str, dataset: DataFrame, metrics: list[str] | None = None, run: str | None = None,
                     summary_path: str | None = None, scores_path: str | None = None, log_path: str | None = None) -> DataFrame:
    """Summary per step of all outputs files of a directory; on request the
    summary, the per-example table and the metric log are written as well."""
    pairs = aligned_outputs(read_outputs(spark, directory), dataset)
    return _scored(pairs, metrics, run, summary_path, scores_path, log_path, [directory])


def score_files(spark: SparkSession, paths: list[str], dataset: DataFrame, metrics: list[str] | None = None, run: str | None = None,
                summary_path: str | None = None, scores_path: str | None = None, log_path: str | None = None) -> DataFrame:
    """The same for given files."""
    pairs = aligned_outputs(read_output_files(spark, paths), dataset)
    return _scored(pairs, metrics, run, summary_path, scores_path, log_path, paths)


def _scored(pairs, metrics, run, summary_path, scores_path, log_path, inputs):
    keys = ["step"]
    if run is not None:
        pairs, keys = pairs.withColumn("run", F.lit(run)), ["run", "step"]
    wide = evaluate(pairs, keys, metrics)
    if summary_path or log_path:  # one small row a step: computed once, then written twice
        wide = wide.sparkSession.createDataFrame(wide.collect(), wide.schema)

    def replace(df, path):  # a step that is scored again replaces its own partition
        (guarded_writer(df, path, "overwrite", inputs).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))

    if summary_path:
        replace(wide, summary_path)
    if log_path:
        replace(metric_log(wide, keys, [c for c in wide.columns if c not in keys]), log_path)
    if scores_path:
        replace(per_example(pairs, keys), scores_path)
    return wide

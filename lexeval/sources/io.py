"""Dataset sources (S1–S6) and result sinks.

* A dataset is one DataFrame with a ``split`` column; each split may come from
  its own file, and every file is read with the reader for its own suffix.
* CSV text holds embedded newlines and doubled quotes, so CSV is always read
  with ``header, multiLine, quote='"', escape='"'``.  A multi-line CSV file is
  one input split, so tables are written as folders of ordered part files;
  positions are counted over parts and splits in file order.
* Lists cannot be stored in CSV: list columns are written as JSON text and
  parsed back on read.
* Writes never silently replace their own input: overwriting a path that is
  also being read deletes the input before it is read (guard S11/X10).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexeval.functions.text import step_from_name

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}  # the writer trims texts otherwise
READERS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}
SPLIT_FILES = ("train", "validation", "test")


def _suffix(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else ""


# S4
def check_files(files: dict[str, str | None], allowed=("csv", "json")) -> dict[str, str]:
    given = {k: v for k, v in files.items() if v is not None}
    if not given:
        raise ValueError("need at least one of train_file, validation_file, test_file")
    for k, v in given.items():
        if _suffix(v) not in allowed:
            raise ValueError(f"{k}_file has an unsupported suffix ({', '.join(allowed)} can be read): {v}")
    return given


def read_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    kind = READERS.get(_suffix(path))
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if kind == "csv":
        return r.options(**CSV_OPTIONS).csv(path)
    if kind == "json":
        return r.option("multiLine", "false").json(path)
    return r.parquet(path)


def dense_index(df: DataFrame, name: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with column ``name``: 0, 1, 2, … in reading order, from 0 again in
    each group (a file or a split), whatever the size of the input splits.

    Rows are numbered inside their task, the tasks' row counts are added up in
    task order — one row per task and group — and joined back.  Nothing is sorted
    and no single task sees all rows."""
    task, within = "__task", "__within"
    marked = df.withColumn(task, F.spark_partition_id()).withColumn(within, F.monotonically_increasing_id())
    own = [task, *groups]
    counts = marked.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"), F.min(within).alias("__low"))
    before = Window.partitionBy(*groups, F.lit(0)).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__s{c}") for c in own], "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = [F.col(c).eqNullSafe(F.col(f"__s{c}")) for c in own]
    on = same[0]
    for c in same[1:]:
        on = on & c
    # the rows of one group lie together in a task: a file is read in one go
    return marked.join(starts, on).select(*df.columns, (F.col("__start") + F.col(within) - F.col("__low")).alias(name))


def file_of(path: Column) -> Column:
    """The file a row belongs to: a folder of part files counts as one."""
    return F.regexp_replace(path, r"(\.(?:csv|json|jsonl))/[^/]*$", "$1")


def file_index(df: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """``df``, read from files, with column ``name``: 0, 1, 2, … in file order,
    from 0 again in each file (a folder of part files is one, its parts in the
    order of their numbers), whichever tasks read them.  ``file`` names a column
    for the file's path.

    The rows of an input split lie together in a task; only the number of rows
    of each split is gathered, one row a split."""
    marked = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__at"),
                       F.monotonically_increasing_id().alias("__within"))
    marked = marked.withColumn("__file", file_of(F.col("__path")))
    part = F.coalesce(F.regexp_extract("__path", r"/part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(0).cast("long"))
    splits = marked.groupBy("__file", "__path", "__at").agg(F.count(F.lit(1)).alias("__n"), F.min("__within").alias("__low"))
    before = Window.partitionBy("__file").orderBy(part, "__path", "__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("__path", "__at", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__start"))
    out = marked.join(starts, ["__path", "__at"])
    return out.select(*df.columns, (F.col("__start") + F.col("__within")).alias(name), *([F.col("__file").alias(file)] if file else []))


def with_example_id(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Explicit identity: a source key when there is one, else the dense
    position in file order."""
    if id_col and id_col in df.columns:
        return df.withColumn("example_id", F.col(id_col).cast("long"))
    return file_index(df, "example_id")


def write_ordered(df: DataFrame, path: str, order: str, parts: int | None = None, mode: str = "errorifexists") -> None:
    """CSV or JSON lines (by the path's suffix) as a folder of part files whose
    numbers follow ``order``; the column itself is left out.  Rows are dealt by
    ranges, so no task sees all of them."""
    dealt = df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)
    w = guarded_writer(_csv_ready(dealt.sortWithinPartitions(order).drop(order)), path, mode)
    if READERS[_suffix(path)] == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.json(path)


# S1 / S2
def load_custom_dataset(spark: SparkSession, train_file: str | None = None, validation_file: str | None = None,
                        test_file: str | None = None, schema=None, id_col: str | None = None) -> DataFrame:
    """Split files (csv or json-lines, each read by its own suffix) stacked into
    one DataFrame with a ``split`` column; columns missing in a split are NULL.
    Ids are dense per split, so a row is known by ``(split, example_id)``."""
    files = check_files({"train": train_file, "validation": validation_file, "test": test_file})
    out = None
    for split, path in files.items():
        d = with_example_id(read_file(spark, path, schema), id_col).withColumn("split", F.lit(split))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


# S3
def load_dataset(spark: SparkSession, path: str, config: str | None = None, split: str | None = None,
                 fmt: str = "parquet") -> DataFrame:
    """A named dataset stored as a table partitioned by ``config``/``split``;
    selecting a config or a split is a partition filter (pruned at the scan)."""
    df = spark.read.format(fmt).load(path)
    if config is not None and "config" in df.columns:
        df = df.where(F.col("config") == config)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    parts = [c for c in ("config", "split") if c in df.columns]
    guarded_writer(df, path, mode).partitionBy(*parts).parquet(path)


# S5 / S6
OUTPUTS = "outputs_*.csv"


def _headers(spark: SparkSession, paths: list[str], pattern: str | None) -> list:
    """(header, paths) of the files, one row per distinct header line."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    lines = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.where("at = 0").groupBy("path").agg(F.first("value").alias("header"))
    return sorted(first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect(), key=lambda r: r.header)


def read_output_files(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """Outputs files as one table.  Files are grouped by their header line and
    each group is read with its own column names, so files whose columns differ
    in order or number can lie side by side; columns that a file lacks are NULL."""
    out = None
    for row in _headers(spark, paths, pattern):  # a handful of column layouts
        df = spark.read.options(**CSV_OPTIONS).option("enforceSchema", "false").csv(row.paths)
        df = normalize_outputs(file_index(df, "pos", "path"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no outputs files in {paths}")
    return out


def read_outputs(spark: SparkSession, directory: str, pattern: str = OUTPUTS) -> DataFrame:
    """Every outputs file of a directory, and of folders of that name written by
    Spark: ``step`` parsed from the name (both dialects), ``pos`` = position
    inside the file, ``source`` from either ``source`` or ``sources``, blank
    predictions as '', ``older`` true for files of the older dialect."""
    return read_output_files(spark, [f"{directory.rstrip('/')}/{pattern}"])


def write_outputs(df: DataFrame, directory: str, step: int, order: str = "example_id", older: bool = False, parts: int | None = None,
                  mode: str = "errorifexists") -> None:
    """The outputs of a step, rows in the order of the examples: a folder of the
    file's name with ordered part files."""
    name = f"outputs_eval-{step}.csv" if older else f"outputs_validation_{step}.csv"
    write_ordered(df, f"{directory.rstrip('/')}/{name}", order, parts, mode)


def normalize_outputs(df: DataFrame) -> DataFrame:
    """``source`` from ``source`` or ``sources`` (both dialects), blank
    prediction → '', ``references`` parsed from the JSON ``reference`` column,
    ``step`` from the file name when absent."""
    src = [F.col(c) for c in ("source", "sources") if c in df.columns]
    cols = {"source": F.coalesce(*src) if src else F.lit(None).cast("string"),
            "prediction": F.coalesce(F.col("prediction"), F.lit(""))}
    if "step" not in df.columns:
        cols["step"] = step_from_name(F.col("path"))
    if "reference" in df.columns:
        cols["references"] = F.from_json(F.col("reference"), "array<string>")
    out = df.withColumns(cols | {"older": F.lit("sources" in df.columns)})
    return out.drop("sources") if "sources" in df.columns else out


# S7 / S8 / S9 / S10 / S11
def guarded_writer(df: DataFrame, path: str, mode: str = "errorifexists", inputs: list[str] | None = None):
    """Refuse to overwrite a path that the job reads: the files of the plan
    itself, and any ``inputs`` named besides; a folder above or below counts."""
    def norm(p):
        return os.path.normpath(p.removeprefix("file:")).replace("//", "/") + os.sep

    if mode == "overwrite":
        files = df.inputFiles()
        for p in {*files, *(os.path.dirname(f) for f in files), *(inputs or [])}:
            if norm(p).startswith(norm(path)) or norm(path).startswith(norm(p)):
                raise ValueError(f"refusing to overwrite {path}: it is an input of this job")
    return df.write.mode(mode)


def _csv_ready(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                  inputs: list[str] | None = None, partition_by=("run", "step")) -> None:
    """Per-example (S7), summary (S8) and heavy (S9) tables: partitioned by
    run and step; CSV stores lists as JSON text."""
    parts = [c for c in partition_by if c in df.columns]
    w = guarded_writer(_csv_ready(df) if fmt == "csv" else df, path, mode, inputs).partitionBy(*parts)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)


def heavy_paths(path: str) -> tuple[str, str]:
    """S9 naming: ``<name>.csv`` → ``<name>_heavy_overall.csv``, ``<name>_heavy_scores.csv``."""
    base = path[:-4] if path.endswith(".csv") else path
    return base + "_heavy_overall.csv", base + "_heavy_scores.csv"


def write_heavy(overall: DataFrame, scores: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """The heavy summary and the per-example heavy scores beside ``path``."""
    for df, target in zip((overall, scores), heavy_paths(path)):
        write_results(df, target, fmt, mode)


def append_metric_log(wide: DataFrame, path: str, keys: list[str], metrics: list[str],
                      prefix: str = "eval/") -> None:
    """``(keys..., metric, value)`` rows into the metric log table, one
    partition per key; a step that is logged again replaces its rows."""
    from lexeval.plans.evaluate import metric_log
    (metric_log(wide, keys, metrics, prefix).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))

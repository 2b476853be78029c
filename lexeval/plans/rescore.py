"""Resumable scoring of a directory of outputs files.

A store keeps, for each outputs file, the summed statistics of its rows (see
``metrics.fused.statistics``) beside what the file was when they were made.  An
update scores what is new or has changed and takes away what is gone; every
corpus score then follows from the sums alone.  A file counts as unchanged while
the names, lengths and times of its parts are; else its rows are read, and where
their fingerprint is the stored one the sums are kept as well (a file copied or
touched).  So a file rewritten in place replaces its own part of the score, and
files that arrive late add theirs.

An update writes a whole new generation of the store (one row a file) and a
reader takes the last complete one: an update that dies leaves the store as it
was, and running it again does the work.  Two updates of one store must not run
at the same time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeval.metrics.fused import Spec, score_columns, specs_of, statistics
from lexeval.plans.evaluate import LIGHT
from lexeval.plans.posthoc import aligned_outputs
from lexeval.sources.io import OUTPUTS, file_of, read_output_files


def _described(specs: list[Spec]) -> str:
    return json.dumps([[s.label, s.metric, s.settings()] for s in specs])


def listing(spark: SparkSession, directory: str, pattern: str = OUTPUTS) -> DataFrame:
    """``(path, version)`` of the outputs files of a directory, a folder of part
    files being one; no file is opened."""
    found = spark.read.format("binaryFile").load(f"{directory.rstrip('/')}/{pattern}").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_size").alias("bytes"))
    part = F.xxhash64("path", F.unix_micros("at"), "bytes")
    return found.groupBy(file_of(F.col("path")).alias("path")).agg(
        F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(part), F.bit_xor(F.xxhash64(part, F.lit(1)))).alias("version"))


def contents(outputs: DataFrame) -> DataFrame:
    """``(path, content)``: a fingerprint of a file's rows and their positions."""
    row = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "pos", F.col("source").isNull(), "source", "prediction", "older"))
    return outputs.groupBy("path").agg(F.concat_ws("-", F.count(F.lit(1)), row(1), row(2)).alias("content"))


def _generations(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the complete generations, ascending; no generation, no store."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(store)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.Path(root, "generation-*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found)


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    done = _generations(spark, store)
    return spark.read.parquet(f"{store}/generation-{done[-1]}") if done else None


def update(spark: SparkSession, directory: str, dataset: DataFrame, store: str, metrics=None, pattern: str = OUTPUTS) -> dict[str, int]:
    """Bring the store in line with the directory; returns how many files were
    ``scored``, ``kept`` and ``dropped``.  ``metrics`` as for ``evaluate``,
    built-in ones; a store holds one choice of them.  ``dataset`` is the split
    that was decoded: (example_id dense from 0, input, references)."""
    specs = specs_of(LIGHT if metrics is None else metrics)
    described = _described(specs)
    before = stored(spark, store)
    if before is not None and before.where(F.col("metrics") != described).limit(1).count():
        raise ValueError(f"{store} was written for other metrics")
    now = listing(spark, directory, pattern)
    # one short row an outputs file
    files = {r.path: r.version for r in now.collect()}
    known = {r.path: (r.version, r.content) for r in before.select("path", "version", "content").collect()} if before is not None else {}
    changed = sorted(p for p, v in files.items() if p not in known or known[p][0] != v)
    if not changed and files.keys() == known.keys():
        return {"scored": 0, "kept": len(files), "dropped": 0}

    touched, fresh = [], []
    content: dict[str, str] = {}
    if changed:
        outputs = read_output_files(spark, changed)
        content = {r.path: r.content for r in contents(outputs).collect()}
        content |= {p: "0" for p in changed if p not in content}
        for p in changed:
            (touched if p in known and known[p][1] == content[p] else fresh).append(p)
    parts = []
    if before is not None:
        same = [p for p in files if p not in fresh]
        versions = spark.createDataFrame([(p, files[p]) for p in same], "path string, version string")
        parts.append(before.drop("version").join(versions, "path").select(*before.columns))
    if fresh:
        rows, stats, _ = statistics(aligned_outputs(read_output_files(spark, fresh), dataset, carry=("path",)), ["path", "step"], specs)
        sums = rows.groupBy("path", "step").agg(*[F.sum(c).alias(n) for n, c in stats.items()])
        facts = spark.createDataFrame([(p, files[p], content[p], described) for p in fresh], "path string, version string, content string, metrics string")
        parts.append(facts.join(sums, "path"))
    if not parts:
        raise ValueError(f"no outputs files in {directory}")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    done = _generations(spark, store)
    out.coalesce(1).write.mode("overwrite").parquet(f"{store}/generation-{(done[-1] if done else 0) + 1}")  # a row a file
    return {"scored": len(fresh), "kept": len(files) - len(fresh), "dropped": len(known.keys() - files.keys())}


def summary(spark: SparkSession, store: str, metrics=None) -> DataFrame:
    """``(step, one column a metric)`` from the sums of the store."""
    specs = specs_of(LIGHT if metrics is None else metrics)
    rows = stored(spark, store)
    if rows is None:
        raise ValueError(f"no store at {store}")
    names = [c for c in rows.columns if c not in ("path", "step", "version", "content", "metrics")]
    sums = rows.where(F.col("metrics") == _described(specs)).groupBy("step").agg(*[F.sum(c).alias(c) for c in names])
    return sums.select("step", *[c.alias(label) for label, c in score_columns(specs).items()])

"""Incremental scoring of outputs files as training writes them.

A training run writes one outputs file per evaluation step.  The stream is one
of file names: a streaming file source picks up only files it has not seen
(tracked in the checkpoint), and every micro-batch reads its files with the
batch reader — by their own headers — aligns them by position, checks them
against the dataset and scores them.  Rows are written with dynamic partition
overwrite, so a replay of a batch rewrites the same ``(run, step)`` partitions.
With ``trigger(availableNow=True)`` a run processes everything new and stops; a
run with no new file writes nothing.  A file that does not belong to the
dataset stops the stream with an error.  A file rewritten in place under a name
already seen is not picked up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeval.plans.posthoc import score_files
from lexeval.sources.io import OUTPUTS, file_of

#: Files of one micro-batch.
FILES_PER_BATCH = 64


def score_new_outputs(spark: SparkSession, outputs_dir: str, dataset: DataFrame, summary_path: str, checkpoint: str, run: str = "run",
                      metrics: list[str] | None = None, log_path: str | None = None, scores_path: str | None = None,
                      pattern: str = OUTPUTS):
    """Start an ``availableNow`` streaming query; returns the StreamingQuery.
    ``dataset`` is the split that was decoded: (example_id dense from 0, input,
    references)."""
    names = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("maxFilesPerTrigger", FILES_PER_BATCH).load(f"{outputs_dir.rstrip('/')}/{pattern}").select("path"))

    def batch(df: DataFrame, epoch_id: int) -> None:
        files = df.select(file_of(F.col("path")).alias("path")).distinct()  # the parts of a step are one file
        paths = sorted(r.path for r in files.collect())  # FILES_PER_BATCH names at most
        if paths:
            score_files(spark, paths, dataset, metrics, run, summary_path, scores_path, log_path)

    return (names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

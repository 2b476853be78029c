"""Spark session helpers.

The engine never picks executor counts or memory itself; it only sets the
SQL knobs the plans depend on (AQE, skew-join handling, UTC) and makes sure a
checkpoint directory exists.  On a cluster ``spark.checkpoint.dir`` points to
shared storage and is left alone; only when it is unset (local tests) a fresh
scratch folder is created.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  They are all SQL-level and safe
# to apply to an existing session.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A kernel holds the tokens of a whole Arrow batch, many times its texts: short batches bound a worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def get_spark(master: str | None = None, app_name: str = "lexeval",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ship_package(spark)
    return spark


def settings(spark: SparkSession) -> None:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)


def configure(spark: SparkSession) -> SparkSession:
    settings(spark)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder used to cut lineage (``DataFrame.checkpoint``) and to
    stage intermediate tables.  Read from the session; a folder of this machine
    is made only for a local master, where it is the shared one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="lexeval-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexeval`` importable in Python workers (pandas UDFs, mapInPandas)
    by adding a zip of the package with ``addPyFile`` — once per SparkContext."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _shipped:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    dest = tempfile.mkdtemp(prefix="lexeval-zip-")  # read by the driver only, which serves it to the executors
    path = os.path.join(dest, f"lexeval-{os.getpid()}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _shipped.add(key)

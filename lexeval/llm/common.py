"""Helpers shared by the training-data operators."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeval.session import checkpoint_dir, configure, ship_package

#: Rows of one Arrow batch sent to Python; texts can be long, so batches are short.
ARROW_ROWS = 1000
#: And no longer than this in bytes, where Spark knows the setting.
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared folder of
    ``spark.checkpoint.dir`` and read it back.  Every executor sees the files,
    so a lost executor costs nothing that is already staged."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = staged.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them,
    which on a quiet driver takes long: ask for it after a large stage.  The
    files go a moment later, so wait for that moment."""
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body refers to it (also from inside lambda functions)."""
    return F.transform(F.array(value), body)[0]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name

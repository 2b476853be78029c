"""Size checks for broadcast decisions.

A side is broadcast only when its size is *known* to be under a limit: the
optimizer's statistics for the plan (exact for file scans and for plans over
them) are compared to the limit; an unknown or larger size keeps the
shuffle-based join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of input files that one task of spread rows gets.
SPREAD_BYTES = 4 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - plan statistics unavailable
        return None


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    limit = DEFAULT_BROADCAST_BYTES if limit is None else limit
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """CPU-heavy per-row work (kernels, tokenisation) needs at least as many
    tasks as there are task slots.  Where the plan's leaves give fewer — one
    file, one row group, an unsplittable multi-line CSV — rows are dealt anew
    over all slots, into more tasks the larger the files are, so that no task
    grows with the input; with enough input partitions they stay where they are.
    Partitions and sizes are read from the planned scan; nothing is executed."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    parts = scan_partitions(df)
    if parts is None or parts >= slots:
        return df
    tasks = max(slots * 2, scan_bytes(df) // SPREAD_BYTES)
    return df.repartition(tasks, *keys) if keys else df.repartition(tasks)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files that the plan's largest scan reads."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        found = [leaves.apply(i) for i in range(leaves.size())]
        return max((int(str(x.stats().sizeInBytes())) for x in found if x.getClass().getSimpleName() == "LogicalRelation"), default=0)
    except Exception:  # pragma: no cover - plan statistics unavailable
        return 0


def scan_partitions(df: DataFrame) -> int | None:
    """Partitions of the largest file scan of the plan; None without one."""
    try:
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        found = [leaves.apply(i) for i in range(leaves.size())]
        sizes = [x.inputRDDs().head().getNumPartitions() for x in found if x.getClass().getSimpleName() == "FileSourceScanExec"]
        return max(sizes) if sizes else None
    except Exception:  # pragma: no cover - a plan without file scans
        return None

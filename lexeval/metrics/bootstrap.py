"""Bootstrap intervals and paired comparisons of corpus scores.

A resample of a corpus draws its examples with replacement.  Here every example
has a Poisson(1) weight in each replicate, taken from a hash of its id and the
replicate's number: no draw depends on another example, so a task weighs its own
rows (one matrix product of weights and statistics a batch), sends one row of
sums a group and replicate, and the sums of all tasks give the replicate's corpus
score by the metric's own formula.  The weights are the same in every group, so
two steps or runs are compared on the same resamples (a paired test).  Replicate
0 weighs each example once: the score itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexeval.metrics.fused import specs_of, statistics

#: Rows of weights made at a time, and groups of which a task holds sums.
ROWS, GROUPS = 1024, 16
#: A weight is the number of these that a 32-bit hash reaches: the distribution function of Poisson(1).
STEPS = [math.floor(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
#: Multipliers of the hash.
MIX, STRIDE = 0x45D9F3B, 0x9E3779B1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer hash of each element (uint64 below 2^32)."""
    low = np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(MIX) & low
    return (x >> np.uint64(16)) ^ x


def weights(ids: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """One row of ``replicates`` + 1 weights for each id, the first of them 1."""
    low = np.uint64(0xFFFFFFFF)
    x = ids.astype(np.int64).view(np.uint64)
    x = mixed(mixed(x & low) ^ (x >> np.uint64(32)))
    r = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(STRIDE) + np.uint64(seed)
    drawn = np.searchsorted(np.array(STEPS, np.uint64), mixed((x[:, None] + r) & low), side="right")
    return np.hstack([np.ones((len(x), 1)), drawn])


def replicate_scores(pairs: DataFrame, keys: list[str], metrics, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """``(keys..., replicate, one column a metric)`` for replicates 0 to
    ``replicates``; ``metrics`` as for ``evaluate``.  A replicate in which no
    weighed example has a statistic gets a NULL score."""
    if not 1 <= replicates < 1 << 16:
        raise ValueError("replicates must lie between 1 and 65535")
    keys = list(keys)
    rows, stats, scores = statistics(pairs, keys, specs_of(metrics))
    names = list(stats)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    # whether a row counts in a sum goes along, so that sums of no row stay NULL
    told = rows.select(key.alias("key"), F.coalesce(F.col("example_id").cast("long"), F.lit(0)).alias("id"),
                       F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in stats.values()],
                               *[c.isNotNull().cast("double") for c in stats.values()]).alias("x"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for k, sums in held.items():
                yield pd.DataFrame({"key": k, "replicate": np.arange(replicates + 1, dtype=np.int32), "x": list(sums)})

        for batch in batches:
            for k, part in batch.groupby("key", sort=False):
                if k not in held and len(held) >= GROUPS:
                    yield from out()
                    held.clear()
                total = held.setdefault(k, np.zeros((replicates + 1, 2 * len(names))))
                for at in range(0, len(part), ROWS):
                    some = part.iloc[at:at + ROWS]
                    total += weights(some["id"].to_numpy(), replicates, seed).T @ np.stack(some["x"].to_list())
        yield from out()

    parts = told.mapInPandas(weigh, "key string, replicate int, x array<double>")
    n = len(names)
    sums = parts.groupBy("key", "replicate").agg(*[F.when(F.sum(F.col("x")[n + i]) > 0, F.sum(F.col("x")[i])).alias(c) for i, c in enumerate(names)])
    kinds = ", ".join(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys)
    named = [F.from_json("key", kinds)[k].alias(k) for k in keys] if keys else []
    return sums.select(*named, "replicate", *[c.alias(label) for label, c in scores.items()])


def intervals(scored: DataFrame, keys: list[str], step: str | None = None, level: float = 0.95) -> DataFrame:
    """``(keys..., metric, score, low, middle, high)`` from the table of
    :func:`replicate_scores`: the score, and the ends and the median of its
    ``level`` interval.  With ``step``, one of the keys, also ``wins``: the share
    of resamples in which the step scores above the step before it (of the same
    other keys), ties counted half; NULL for the first step."""
    keys = list(keys)
    names = [c for c in scored.columns if c not in (*keys, "replicate")]
    long = scored.unpivot([*keys, "replicate"], names, "metric", "value")
    drawn = F.col("replicate") > 0
    tail = (1 - level) / 2
    aggs = [F.max(F.when(~drawn, F.col("value"))).alias("score"),
            F.percentile(F.when(drawn, F.col("value")), F.array(*[F.lit(x) for x in (tail, 0.5, 1 - tail)])).alias("ends")]
    if step:  # a window holds the steps of one run
        before = F.lag("value").over(Window.partitionBy(*[k for k in keys if k != step], "metric", "replicate").orderBy(step))
        long = long.withColumn("gain", F.col("value") - before)
        aggs.append(F.avg(F.when(drawn, F.when(F.col("gain") > 0, 1.0).when(F.col("gain") == 0, 0.5).when(F.col("gain") < 0, 0.0))).alias("wins"))
    out = long.groupBy(*keys, "metric").agg(*aggs)
    ends = [F.col("ends")[i].alias(n) for i, n in enumerate(("low", "middle", "high"))]
    return out.select(*keys, "metric", "score", *ends, *(["wins"] if step else []))


def bootstrap(pairs: DataFrame, keys: list[str], metrics, replicates: int = 1000, seed: int = 0, step: str | None = None, level: float = 0.95) -> DataFrame:
    """Intervals of the corpus scores of every group, see :func:`intervals`."""
    return intervals(replicate_scores(pairs, keys, metrics, replicates, seed), keys, step, level)

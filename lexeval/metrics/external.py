"""Aggregation of externally computed per-(example, reference) scores
(learned metrics such as COMET or BLEURT are models, not data work; their
scores arrive as a column or from a user function).

Rule shared by both learned metrics: score every (prediction, reference)
pair, keep the best per example, report the mean.  Examples without any
reference get a NULL score and are left out of the mean.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexeval.operators.align import best_per_owner, flatten_references


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], keys=(),
                with_sources: bool = False) -> DataFrame:
    """Flatten references (A1) and apply a user scorer to Arrow batches of
    ``(prediction, reference[, source])`` rows; returns one score per pair."""
    flat = flatten_references(pairs, keys)
    cols = ["prediction", "reference"] + (["source"] if with_sources else [])
    schema = StructType(flat.schema.fields + [StructField("score", DoubleType())])

    def fn(batches):
        for pdf in batches:
            yield pdf.assign(score=scorer(pdf[cols]).astype("float64").values)

    return flat.mapInPandas(fn, schema)


def external_per_example(scores: DataFrame, examples: DataFrame | None = None, keys=(),
                         name: str = "score") -> DataFrame:
    best = best_per_owner(scores, keys, "example_id", "score", name)
    if examples is None:
        return best
    return examples.select(*keys, "example_id").join(best, [*keys, "example_id"], "left")


def external_summary(per_example: DataFrame, keys=(), name: str = "score") -> DataFrame:
    return per_example.groupBy(*keys).agg(F.avg(name).alias(name))

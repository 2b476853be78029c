"""Batched row functions.

``map_batches(df, fn, schema)`` applies a pandas function to Arrow batches of
rows in every partition (parallelism = partitions; no worker count to set).
The function's output replaces the columns, like a batched ``map`` with
``remove_columns``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)

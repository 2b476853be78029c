"""Metrics that a user writes as aggregators.

An aggregator folds rows into a state, joins states, and turns the last one
into a number.  :func:`aggregate` runs any number of them in one pass: each task
folds the Arrow batches of its rows into one state a group and aggregator, only
the states are shuffled, and they are joined in two turns (first those of a
lane of tasks, then the lanes), so a group that holds most rows costs one state
a task and no task joins the states of all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lanes of tasks whose states are joined before those of a whole group.
LANES = 64
#: Groups of which a task holds states at a time; beyond it they are sent on early.
GROUPS = 1024


class Aggregator(Protocol):
    """States must be picklable and of bounded size; ``merge`` must not depend
    on the order of the states, nor ``update`` on how rows are cut into batches."""

    #: Columns that ``update`` reads.
    columns: tuple[str, ...]

    def zero(self) -> Any: ...

    def update(self, state: Any, rows: pd.DataFrame) -> Any: ...

    def merge(self, left: Any, right: Any) -> Any: ...

    def finish(self, state: Any) -> float | None: ...


def aggregate(pairs: DataFrame, keys: list[str], aggregators: dict[str, Aggregator]) -> DataFrame:
    """``(keys..., one double a label)``, one row a group.  NULL keys are a group
    like any other.  Without keys there is one row, also for no rows."""
    keys, labels, todo = list(keys), list(aggregators), list(aggregators.values())
    columns = list(dict.fromkeys(c for a in todo for c in a.columns))
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    rows = pairs.select(key.alias("__key"), F.spark_partition_id().alias("__task"), *columns)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        task = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"key": list(held), "lane": task % LANES, "states": [pickle.dumps(s) for s in held.values()]})

        for batch in batches:
            if len(batch):
                task = int(batch["__task"].iat[0])
            for k, part in batch.groupby("__key", sort=False):
                if k not in held:
                    if len(held) >= GROUPS:
                        yield out()
                        held.clear()
                    held[k] = [a.zero() for a in todo]
                held[k] = [a.update(s, part) for a, s in zip(todo, held[k])]
        if held:
            yield out()

    def joined(group: pd.DataFrame) -> list:
        states = None
        for packed in group["states"]:
            these = pickle.loads(packed)
            states = these if states is None else [a.merge(x, y) for a, x, y in zip(todo, states, these)]
        return states

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": group["key"].iloc[:1], "states": [pickle.dumps(joined(group))]})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        values = [a.finish(s) for a, s in zip(todo, joined(group))]
        return pd.DataFrame({"key": group["key"].iloc[:1], "values": [[None if v is None else float(v) for v in values]]})

    states = rows.mapInPandas(fold, "key string, lane int, states binary")
    if not keys:  # a state of no rows
        states = states.unionByName(pairs.sparkSession.createDataFrame([("{}", 0, pickle.dumps([a.zero() for a in todo]))], states.schema))
    lanes = states.groupBy("key", "lane").applyInPandas(merge, "key string, states binary")
    done = lanes.groupBy("key").applyInPandas(finish, "key string, values array<double>")
    kinds = ", ".join(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys)
    named = [F.from_json("key", kinds)[k].alias(k) for k in keys] if keys else []
    return done.select(*named, *[F.col("values")[i].alias(label) for i, label in enumerate(labels)])

"""Aligning predictions with references, flattening and regrouping
references, and de-duplicating older outputs files.

Identity is always the explicit ``example_id`` — never row position.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeval.operators.sizing import broadcast_if_small


# J1
def align(predictions: DataFrame, references: DataFrame, on: str = "example_id",
          max_broadcast_bytes: int | None = None) -> DataFrame:
    """Attach each prediction to the references of its example (inner
    equi-join on ``example_id``).  Many runs × steps share one reference set,
    so the reference side is broadcast when its measured size is under the
    limit; otherwise both sides are hash-partitioned on ``example_id``
    (sort-merge, AQE handles skewed ids)."""
    refs = broadcast_if_small(references, max_broadcast_bytes)
    return predictions.join(refs, on, "inner")


# J2
def alignment_report(outputs: DataFrame, inputs: DataFrame, got: str = "source",
                     expected: str = "input", on: str = "example_id") -> DataFrame:
    """Rows whose output source differs from the dataset input (NULL-safe),
    including examples present on one side only."""
    o = outputs.select(on, F.col(got).alias("got"))
    i = inputs.select(on, F.col(expected).alias("expected"))
    j = i.join(o, on, "full_outer")
    return j.where(~F.col("expected").eqNullSafe(F.col("got"))).select(on, "expected", "got")


def check_alignment(outputs: DataFrame, inputs: DataFrame, **kw) -> None:
    """Raise if any example's source differs from the dataset input."""
    bad = alignment_report(outputs, inputs, **kw)
    sample = bad.limit(5).collect()
    if sample:
        raise ValueError(f"outputs do not belong to these examples: {sample}")


# A1
def flatten_references(df: DataFrame, keys=(), carry=("prediction", "source")) -> DataFrame:
    """One row per (example, reference) with the reference's index in its list."""
    cols = [c for c in carry if c in df.columns]
    return df.select(*keys, "example_id", *cols, F.posexplode("references").alias("ref_idx", "reference"))


# A2
def pad_references(df: DataFrame, pad: str = "") -> DataFrame:
    """Pad every reference list with ``pad`` to the longest list in the table.
    The maximum is a scalar subquery (one small aggregation, no join)."""
    m = df.select(F.max(F.size("references"))).scalar()
    return df.withColumn("references", F.concat(
        "references", F.array_repeat(F.lit(pad), F.greatest(m - F.size("references"), F.lit(0)))))


# M11
def max_reference_count(df: DataFrame, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.size("references")).alias("max_references"))


# A3
def best_per_owner(scores: DataFrame, keys=(), owner: str = "example_id", score: str = "score",
                   name: str | None = None) -> DataFrame:
    """Best score per owner (hash aggregation with map-side partial max, so a
    hot owner costs one partial value per task).  Owners are whatever ids
    occur — gaps are fine."""
    return scores.groupBy(*keys, owner).agg(F.max(score).alias(name or score))


# D1
class _Recent:
    """The last ``window`` kept sources of the current run, over rows in order."""

    def __init__(self, window: int, incoming=None):
        self.window, self.run, self.state = window, incoming and incoming[0], list(incoming[1]) if incoming else []

    def keep(self, runs, sources):
        out = []
        for run, source in zip(runs, sources):
            if run != self.run:
                self.run, self.state = run, []
            new = source not in self.state
            if new:
                self.state.append(source)
                del self.state[:-self.window]
            out.append(new)
        return out


def _rows_of(batch, keys, source_col):
    runs = list(zip(*(batch.column(k).to_pylist() for k in keys)))
    return runs, batch.column(source_col).to_pylist()


def dedup_recent_sources(df: DataFrame, run_cols=("run",), order_col: str = "pos", source_col: str = "source",
                         window: int = 3) -> DataFrame:
    """Order-preserving de-duplication of older outputs files: a row is dropped
    when its source is among the last ``window`` *kept* sources of the same run
    (first occurrence wins; an older repeat is kept again once it left the
    window).  NULL runs form one run and NULL sources are equal.

    The rule is a sequential state machine per run, yet one run may hold most
    rows, so rows are range-partitioned on (run, position) and a run may span
    partitions.  What a partition needs from its predecessor is the state of the
    run that crosses the border, at most ``window`` sources.  All partitions are
    first run from an empty state; a partition whose predecessor then leaves
    another state than it was run from is run again, until nothing changes.
    That fixed point is the sequential result, whatever the data.  A partition
    inside one run that holds at most ``window`` different sources needs no
    second run: where they and the incoming ones fit the window together, the
    outgoing state follows without its rows.  Only the border states, one small
    row a partition, reach the driver; the rows stay in the checkpoint."""
    from lexeval.session import checkpoint_dir
    spark, keys = df.sparkSession, list(run_cols)
    checkpoint_dir(spark)
    ranged = df.repartitionByRange(*keys, order_col).sortWithinPartitions(*keys, order_col).checkpoint(eager=True)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    run_type = "struct<" + ",".join(f"k{i}:{fields[k]}" for i, k in enumerate(keys)) + ">"
    border = (f"part int, first {run_type}, last {run_type}, state array<{fields[source_col]}>, "
              f"few array<{fields[source_col]}>")
    arrow = pa_schema(border)

    def ends(incoming, wanted):
        def run(batches):
            part = TaskContext.get().partitionId()
            if wanted is not None and part not in wanted:
                return
            recent, first, seen = _Recent(window, incoming.get(part)), None, []
            for batch in batches:
                runs, sources = _rows_of(batch, keys, source_col)
                if not runs:
                    continue
                first = runs[0] if first is None else first
                recent.keep(runs, sources)
                for s in sources if len(seen) <= window else ():
                    if s not in seen:
                        seen.append(s)
            if first is not None:
                named = lambda r: {f"k{i}": v for i, v in enumerate(r)}
                few = seen if len(seen) <= window and first == recent.run else None
                yield pa.RecordBatch.from_pylist([{"part": part, "first": named(first), "last": named(recent.run),
                                                   "state": recent.state, "few": few}], schema=arrow)
        return run

    narrow = ranged.select(*keys, source_col)
    parts, used, incoming, wanted = {}, {}, {}, None
    while wanted is None or wanted:
        for r in narrow.mapInArrow(ends(incoming, wanted), border).collect():
            parts[r.part] = (tuple(r.first), tuple(r.last), list(r.state), r.few)
            used[r.part] = incoming.get(r.part)
        incoming, wanted, before = {}, set(), None
        for p in sorted(parts):
            first, last, state, few = parts[p]
            if before is not None and before[0] == first and before[1]:
                incoming[p] = before
            if incoming.get(p) != used[p] and first == last:  # its outgoing state may depend on what comes in
                came = incoming[p][1] if p in incoming else []
                if few is not None and len(set(came) | set(few)) <= window:
                    state = came + [s for s in few if s not in came]
                else:
                    wanted.add(p)
            before = (last, state)

    def final(batches):
        recent = _Recent(window, incoming.get(TaskContext.get().partitionId()))
        for batch in batches:
            runs, sources = _rows_of(batch, keys, source_col)
            if runs:
                yield batch.filter(pa.array(recent.keep(runs, sources), pa.bool_()))

    return ranged.mapInArrow(final, df.schema)


def pa_schema(ddl: str):
    """Arrow schema of a DDL text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))

"""Registered queries that score several runs against one reference table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexeval.metrics import shared
from lexeval.plans import views as V
from lexeval.plans.oracle import ORACLE
from lexeval.plans.queries import KEYS, SEP, SUMMARY, L, query, r6


def _table(spark, sf_dir) -> str:
    name = f"references_{uuid.uuid4().hex}"
    shared.write_reference_table(V.eval_refs(spark, sf_dir), name, SUMMARY)
    return name


@query("shared_references")
def q_shared(spark, sf_dir):
    """M1 to M6 + M12 for two runs, one of two steps and one of one, against
    references that were tokenised once."""
    name, preds = _table(spark, sf_dir), V.eval_preds(spark, sf_dir)
    first = shared.evaluate_against(spark, preds.where("step < 3"), name, KEYS, SUMMARY)
    second = shared.evaluate_against(spark, preds.where("step = 3"), name, KEYS, SUMMARY)
    return first.union(second).select(L("step").alias("step"), *[r6(F.col(m), m) for m in SUMMARY])


ORACLE["shared_references"] = ORACLE["summary_wide"]


@query("shared_per_example")
def q_shared_per_example(spark, sf_dir):
    """M13 against the same kind of table."""
    pe = shared.per_example_against(spark, V.eval_preds(spark, sf_dir), _table(spark, sf_dir), KEYS)
    return pe.select(L("step").alias("step"), L("example_id").alias("example_id"), "source", "prediction",
                     F.array_join("references", SEP).alias("refs_text"), r6(F.col("chrf"), "chrf"), r6(F.col("meteor"), "meteor"))


ORACLE["shared_per_example"] = ORACLE["per_example"]

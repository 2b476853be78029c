"""Deterministic views over the driver tables (Spark side).

Each view is a pure DataFrame derivation of the parquet tables, so its size
grows with the tables.  The DuckDB twin of every view is in
``lexeval.plans.sql_views``; both must produce identical rows.

Shapes (see FIXTURES.md §2):

* ``eval_refs``   example_id, source, references   (one row per conversation turn)
* ``eval_preds``  step, example_id, prediction     (3 steps per turn)
* ``eval_pairs``  eval_preds ⋈ eval_refs on example_id
* ``ref_groups``  example_id, split, modified_triple_sets, lex{text,lang,source}
* ``triple_sets`` example_id, modified_triple_sets (one set per order)
* ``translations``, ``dialogue_acts``, ``splits``
* ``scored_refs`` example_id, ref_idx, reference, score
* ``dedup_stream`` run, pos, source, prediction
* ``token_vectors`` example_id, side, ref_idx, tok, embedding
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeval.functions.text import split_ws
from lexeval.session import settings, ship_package

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# Fixed fixture parameters (shared with the SQL twins).
STEPS = (1, 2, 3)
REF_TARGET_LANG = "en"
REF_LEX_SOURCE = "src1"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    settings(spark)
    ship_package(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def split_of(id_col) -> F.Column:
    m = F.pmod(id_col, F.lit(10))
    return F.when(m == 0, "validation").when(m == 1, "test").otherwise("train")


# ---------------------------------------------------------------- evaluation
def eval_refs(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    w = split_ws("text")
    full = F.array_join(w, " ")
    thinned = F.array_join(F.filter(w, lambda x, i: (i + 1) % 7 != 0), " ")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"),
        F.concat_ws(" - ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("source"),
        F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), F.array().cast("array<string>"))
        .when((F.col("conv_id") % 10 == 4) & (F.col("turn") == 1), F.array(F.lit("")))
        .when(F.col("turn") % 3 == 0, F.array(full)).otherwise(F.array(full, thinned)).alias("references"),
    )


def eval_preds(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    c = c.select("conv_id", "turn", "text", F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("step"))
    w = split_ws("text")
    return c.select(
        "step",
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"),
        F.array_join(F.filter(w, lambda x, i: (i + 1) % (F.col("step") * 4) != 0), " ").alias("prediction"),
    )


def eval_pairs(spark, sf_dir) -> DataFrame:
    return eval_preds(spark, sf_dir).join(eval_refs(spark, sf_dir), "example_id")


# ------------------------------------------------------------- dataset shapes
def ref_groups(spark, sf_dir) -> DataFrame:
    """Triples-dataset shape: ten documents per example; their texts are the
    candidate references, their (doc_id, lang, source) the single triple set."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    g = (d.groupBy(F.floor(F.col("doc_id") / 10).alias("example_id"))
         .agg(F.sort_array(F.collect_list(F.struct("doc_id", "text", "lang", "source"))).alias("items")))
    triple = lambda x: F.concat_ws(" | ", x["doc_id"].cast("string"), x["lang"], x["source"])
    return g.select(
        "example_id",
        split_of(F.col("example_id")).alias("split"),
        F.struct(F.array(F.transform("items", triple)).alias("mtriple_set")).alias("modified_triple_sets"),
        F.struct(
            F.transform("items", lambda x: x["text"]).alias("text"),
            F.transform("items", lambda x: x["lang"]).alias("lang"),
            F.transform("items", lambda x: x["source"]).alias("source"),
        ).alias("lex"),
    )


def triple_sets(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    g = (li.groupBy(F.col("l_orderkey").alias("example_id"))
         .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items")))
    s = F.transform("items", lambda x: F.concat_ws(" | ", x["l_partkey"].cast("string"),
                                                   x["l_suppkey"].cast("string"),
                                                   x["l_linenumber"].cast("string")))
    return g.select("example_id", F.struct(F.array(s).alias("mtriple_set")).alias("modified_triple_sets"))


def translations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u_text"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("a_text"))
    j = u.join(a, ["conv_id", "turn"])
    return j.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"),
        split_of(F.col("conv_id")).alias("split"),
        F.struct(F.col("u_text").alias("en"), F.col("a_text").alias("cs")).alias("translation"),
    )


def dialogue_acts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"),
        split_of(F.col("conv_id")).alias("split"),
        F.col("role").alias("da"), "text",
    )


def splits(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return d.select(F.col("doc_id").alias("example_id"), split_of(F.col("doc_id")).alias("split"),
                    F.col("text").alias("input"), "lang")


def scored_refs(spark, sf_dir) -> DataFrame:
    """Filtered references of ``ref_groups``, one row per kept reference, with a
    stand-in external score (reference length / 1000)."""
    from lexeval.operators.recipes import filter_lexicalizations
    f = filter_lexicalizations(ref_groups(spark, sf_dir), REF_TARGET_LANG, REF_LEX_SOURCE)
    e = f.select("example_id", F.posexplode("lex").alias("ref_idx", "reference"))
    return e.withColumn("score", F.length("reference") / F.lit(1000.0))


def dedup_stream(spark, sf_dir) -> DataFrame:
    """Older outputs files: rows of one run in file order; ``source`` repeats."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return e.select(F.col("user_id").alias("run"), F.col("ts").alias("pos"),
                    F.col("event_type").alias("source"), F.col("event_id").alias("prediction"))


def token_vectors(spark, sf_dir) -> DataFrame:
    """Token embeddings: per example 4 candidate tokens, 3 tokens of reference 0
    and 3 of reference 1."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    m = F.pmod("vec_id", F.lit(10))
    return e.select(
        F.floor(F.col("vec_id") / 10).alias("example_id"),
        F.when(m <= 3, "cand").otherwise("ref").alias("side"),
        F.when(m <= 3, F.lit(None)).when(m <= 6, 0).otherwise(1).cast("int").alias("ref_idx"),
        F.col("vec_id").alias("tok"),
        "embedding",
    )

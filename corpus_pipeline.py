"""Corpus pipeline over ``documents``: language ID, line dedup, near-duplicate
removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; ``run`` writes it as Parquet and reads it again for the
next one.  All but the last return the columns of ``docs``.  Other tables come
from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document needs this calibrated probability of its language.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those whose language stays uncertain go."""
    from lexeval.llm.common import fresh, prepare
    from lexeval.llm.langid import UNKNOWN, fit, held_out, predictor

    prepare(spark)
    model = fit(docs.where(~held_out(F.col("doc_id"), 3, 1)).select("text", "lang"))
    p = fresh(docs, "language")
    found = docs.withColumn(p, predictor(model)(F.col("text")))
    return found.where((F.col(p)["lang"] != UNKNOWN) & (F.col(p)["score"] >= LEAST_LANGUAGE_SCORE)).drop(p)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar lines the first stays; documents that
    lose all their lines go; ``n_chars`` follows the text."""
    from lexeval.llm.common import prepare
    from lexeval.llm.linededup import dedup_lines

    prepare(spark)
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8)
    the document with the smallest id stays; equal rows stay once."""
    from lexeval.llm.common import prepare
    from lexeval.llm.minhash import keep_first

    prepare(spark)
    return keep_first(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    from lexeval.llm.common import prepare, table
    from lexeval.llm.decontam import drop_documents

    prepare(spark)
    return drop_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 2048."""
    from lexeval.llm.common import prepare
    from lexeval.llm.packing import pack
    from lexeval.llm.queries import tokenizer_path

    prepare(spark)
    return pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

#: The language model and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another."""
    from lexeval.llm.common import prepare, stage, table

    docs = table(prepare(spark), sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs

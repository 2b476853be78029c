"""Registered queries of the training-data operators: each applies its operator
with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeval.llm import archives, divergence, lexical, linededup, quality, sharding, urlfilter
from lexeval.llm.common import prepare, shared_path, table


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.minhash import near_duplicates

    found = near_duplicates(table(prepare(spark), sf_dir, "documents"), shingle=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.quality import quality_rules

    return quality_rules(table(prepare(spark), sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_upper")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dropped_lines(table(prepare(spark), sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written; the rows come from what then lies in their folders."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return sharding.sharded(docs, shared_path(spark, "shards"), F.col("doc_id")).select(
        "doc_id", "shard", F.length("shard").alias("depth"), "bytes", "shard_bytes", "shard_rows",
        (F.col("shard_bytes") > sharding.SHARD_BYTES).alias("oversized"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.pages_round_trip(table(prepare(spark), sf_dir, "pages"), least=0)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.packing import pack

    return pack(table(prepare(spark), sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.decontam import covered, scan

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"), "found").select(
        "doc_id", F.col("found.n_words").alias("n_words"), covered(F.col("found.spans")).alias("n_hit"),
        F.sort_array("found.items").alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(prepare(spark), sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.langid import fit, held_out, predictor

    docs = table(prepare(spark), sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 3, 1)).select("text", "lang"))
    return docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"),
                       predictor(model)(F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.langid import held_out
    from lexeval.llm.toxicity import fit, judge

    docs = table(prepare(spark), sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = fit(docs.select("doc_id", "text"), labels)
    return docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), judge(model)(F.col("text")).alias("j")).select(
        "doc_id", "held_out", F.col("j.score").alias("score"), (F.col("j.score") >= 0.5).cast("int").alias("predicted"),
        F.size("j.offending").cast("long").alias("n_offending"),
        F.array_join("j.offending.sentence", "\n").alias("offending"))  # no sentence holds a line feed


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.divergence import divergence

    return divergence(table(prepare(spark), sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from lexeval.llm.bytebpe import decode, digests, encode

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(table(prepare(spark), sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexeval.llm.lexical import ranked

    prepare(spark)
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_language": op8_language,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_search": op13_lexical_search,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op3_sharding": sharding.oracle_sql(sharding.SHARD_BYTES),
    "op7_url_filter": urlfilter.oracle_sql(),
    "op1_quality": quality.oracle_sql(),
    "op11_source_divergence": divergence.oracle_sql(),
    "op13_lexical_search": lexical.oracle_sql(),
    "op6_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
           translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w
  FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
           translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
pos AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, list_slice(w, i, i + least(10, len(w)) - 1) AS g FROM pos),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT a.rid, a.i, a.n, win.item
         FROM (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS g FROM grams) a JOIN win ON a.g = win.g),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit
              FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)""",
}

"""The tokenizers of the kernels against the column expressions."""
import random

from pyspark.sql import functions as F

from lexeval.functions import pytokens, text as TX
from lexeval.operators import sizing

PIECES = ["a", "Word", "3.5", "1,000", "x-\ny", "-", "--5-6", "&quot;", "&amp;lt;", "<skipped>", "don't", "(a)", ".", "..", "[b]", "{~}", "\n", "\t", "\x1c",
          "\x85", "\xa0", " ", "　", "é", "Ş", "İ", "ΑΣ", "«q»", "…", "日本", "😀", "_", "^", "\\", "$1", "''", "'s", " ", "", "\x0b", "\x00", "\x7f", "K", "ß"]


def test_kernels_cut_texts_as_the_columns_do(spark):
    random.seed(3)
    texts = [*PIECES, *["".join(random.choice(PIECES) + random.choice(["", " ", "."]) for _ in range(random.randrange(1, 14))) for _ in range(400)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.lower("t").alias("low"), TX.tok_13a("t").alias("bleu"), TX.tok_13a("t", True).alias("lower"), TX.chrf_chars("t").alias("chars"),
                     TX.chrf_words("t").alias("words"), TX.rouge_tokens("t").alias("rouge"), TX.ter_tokens("t").alias("ter"), TX.meteor_tokens("t").alias("meteor")).collect()
    for r in rows:
        assert pytokens.tok_13a(r.t) == r.bleu and pytokens.tok_13a(r.low) == r.lower, r.t
        assert pytokens.chrf_chars(r.t) == r.chars and pytokens.chrf_words(r.t) == r.words, r.t
        assert pytokens.rouge_tokens(r.low) == r.rouge and r.low.split() == r.ter, r.t
        assert not r.low.isascii() or pytokens.meteor_tokens(r.low) == r.meteor, r.t


def test_the_fused_kernel_gets_texts_in_short_batches(spark):
    from lexeval.plans.queries import QUERIES
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = QUERIES["summary_wide"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "&quot;" not in plan  # no tokens are made outside the kernel, but those of METEOR beyond ASCII


def test_tasks_of_spread_rows_grow_with_the_files(spark, tmp, monkeypatch):
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(f"{tmp}/x")
    df = spark.read.parquet(f"{tmp}/x")
    monkeypatch.setattr(sizing, "SPREAD_BYTES", 1 << 14)
    tasks = sizing.spread(df).rdd.getNumPartitions()
    assert tasks == sizing.scan_bytes(df) >> 14 > 2 * spark.sparkContext.defaultParallelism

"""Registered queries of the file sources and sinks, of post-hoc and
incremental scoring, of heavy metric families and of user functions.

Each writes views of the driver tables below the shared folder in the formats
the operators read, reads them back through the operator, and returns what its
SQL twin computes from the tables directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeval.functions import text as TX
from lexeval.metrics import embedding, external
from lexeval.operators import align, recipes, rowfn, tokens
from lexeval.plans import evaluate as EV
from lexeval.plans import oracle as O
from lexeval.plans import posthoc
from lexeval.plans import sql_views as S
from lexeval.plans import views as V
from lexeval.plans.oracle import ORACLE
from lexeval.plans.queries import KEYS, SEP, SUMMARY, L, query, r6, sj
from lexeval.plans.sql_views import with_views
from lexeval.session import scratch_path
from lexeval.sources import io

#: Part files of each written table.
PARTS = 8


# ------------------------------------------------------------ fixtures as files
def written_dataset(spark, sf_dir) -> DataFrame:
    """The evaluation split as ordered CSV parts, loaded again: ids are positions."""
    path = scratch_path(spark, "dataset") + "/validation.csv"
    refs = V.eval_refs(spark, sf_dir).select("example_id", F.col("source").alias("input"), F.to_json("references").alias("reference"))
    io.write_ordered(refs, path, "example_id", PARTS)
    d = io.load_custom_dataset(spark, validation_file=path)
    return d.select("example_id", "input", F.from_json("reference", "array<string>").alias("references"))


def written_outputs(spark, sf_dir) -> str:
    """Outputs files of three steps: step 1 in the current dialect, step 2 in the
    older one with every row twice, step 3 with other columns in another order."""
    folder = scratch_path(spark, "outputs")
    rows = V.eval_preds(spark, sf_dir).join(V.eval_refs(spark, sf_dir), "example_id").select(
        "step", "example_id", "source", "prediction", F.to_json("references").alias("reference"))
    of = lambda s: rows.where(F.col("step") == s).drop("step")
    io.write_outputs(of(1), folder, 1, parts=PARTS)
    twice = of(2).select("example_id", F.col("source").alias("sources"), "prediction", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    io.write_outputs(twice.drop("again"), folder, 2, older=True, parts=PARTS)
    io.write_outputs(of(3).select("example_id", F.length("prediction").alias("score"), "prediction", "reference", "source"), folder, 3, parts=PARTS)
    return folder


# ------------------------------------------------------------ S1-S6
@query("custom_dataset")
def q_custom(spark, sf_dir):
    """S1 + S2: JSON-lines splits and a CSV split, each read by its own suffix,
    dense ids per split in the order of the part files."""
    base = scratch_path(spark, "custom")
    d = V.splits(spark, sf_dir)
    files = {"train": "train.json", "validation": "validation.json", "test": "test.csv"}
    for split, name in files.items():
        io.write_ordered(d.where(F.col("split") == split).select("example_id", "input", "lang"), f"{base}/{name}", "example_id", PARTS)
    out = io.load_custom_dataset(spark, **{f"{split}_file": f"{base}/{name}" for split, name in files.items()})
    return out.select(L("example_id").alias("example_id"), "split", "input", "lang")


ORACLE["custom_dataset"] = with_views(["splits"], """
SELECT (row_number() OVER (PARTITION BY split ORDER BY example_id) - 1)::BIGINT AS example_id, split, input, lang FROM splits""")


@query("dataset_split")
def q_dataset_split(spark, sf_dir):
    """S3: one split of a named dataset, a partition filter."""
    path = scratch_path(spark, "named")
    io.write_dataset(V.splits(spark, sf_dir), path)
    d = io.load_dataset(spark, path, split="validation")
    return d.select(L("example_id").alias("example_id"), "split", "input", "lang")


@query("step_files")
def q_step_files(spark, sf_dir):
    """S4 + S5 + F2 + O1: outputs files of both dialects, their steps and rows, in
    ascending step order."""
    out = io.read_outputs(spark, written_outputs(spark, sf_dir))
    rows = out.groupBy("path", "step", "older").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    return rows.select(L("step").alias("step"), "older", L("n").alias("n"), L("last").alias("last")).orderBy("step")


ORACLE["step_files"] = """
SELECT step::BIGINT AS step, step = 2 AS older, (n * CASE WHEN step = 2 THEN 2 ELSE 1 END)::BIGINT AS n,
       (n * CASE WHEN step = 2 THEN 2 ELSE 1 END - 1)::BIGINT AS last
FROM (SELECT unnest([1, 2, 3]) AS step), (SELECT count(*) AS n FROM conversations)"""


@query("outputs_columns")
def q_outputs_columns(spark, sf_dir):
    """S6 + J2: rows by position, sources of both dialects, checked against the
    dataset."""
    a = posthoc.aligned_outputs(io.read_outputs(spark, written_outputs(spark, sf_dir)), written_dataset(spark, sf_dir))
    return a.select(L("step").alias("step"), L("example_id").alias("example_id"), "source", "prediction",
                    L(F.size("references")).alias("n_refs"))


ORACLE["outputs_columns"] = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, (dense_rank() OVER (ORDER BY example_id) - 1)::BIGINT AS example_id, source,
       coalesce(prediction, '') AS prediction, len("references")::BIGINT AS n_refs FROM eval_pairs""")


# ------------------------------------------------------------ S7-S11, R1
def _summary(df):
    return df.select(L("step").alias("step"), *[r6(F.col(m), m) for m in SUMMARY])


@query("outputs_summary")
def q_outputs_summary(spark, sf_dir):
    """Post-hoc scoring of an outputs directory."""
    folder, done = written_outputs(spark, sf_dir), scratch_path(spark, "scored")
    posthoc.evaluate_outputs(spark, folder, written_dataset(spark, sf_dir), SUMMARY, summary_path=done)
    return _summary(spark.read.parquet(done))


ORACLE["outputs_summary"] = ORACLE["summary_wide"]


@query("stream_summary")
def q_stream(spark, sf_dir):
    """The same directory scored by the incremental stream."""
    from lexeval.streaming.incremental import score_new_outputs
    done = scratch_path(spark, "stream")
    q = score_new_outputs(spark, written_outputs(spark, sf_dir), written_dataset(spark, sf_dir), done + "/summary", done + "/offsets",
                          run="r", metrics=SUMMARY)
    q.awaitTermination()
    return _summary(spark.read.parquet(done + "/summary"))


ORACLE["stream_summary"] = ORACLE["summary_wide"]


@query("per_example_files")
def q_per_example_files(spark, sf_dir):
    """The per-example table as CSV with lists as JSON text, read back."""
    path = scratch_path(spark, "per-example")
    io.write_results(EV.per_example(V.eval_pairs(spark, sf_dir), KEYS), path, "csv", partition_by=("step",))
    back = spark.read.options(**io.CSV_OPTIONS).csv(path)
    refs = F.from_json("references", "array<string>")
    return back.select(L("step").alias("step"), L("example_id").alias("example_id"), "source", "prediction",
                       F.array_join(refs, SEP).alias("refs_text"), r6(F.col("chrf").cast("double"), "chrf"),
                       r6(F.col("meteor").cast("double"), "meteor"))


ORACLE["per_example_files"] = ("SELECT * REPLACE (nullif(prediction, '') AS prediction, coalesce(refs_text, '') AS refs_text) FROM ("
                               + ORACLE["per_example"] + ")")


@query("metric_log_table")
def q_log_table(spark, sf_dir):
    """S10 + S11: the metric log written twice; a step that is logged again
    replaces its rows."""
    path = scratch_path(spark, "log")
    wide = EV.evaluate(V.eval_pairs(spark, sf_dir), KEYS, ["word_edit_rate"])
    for _ in range(2):
        io.append_metric_log(wide, path, KEYS, ["word_edit_rate"])
    return spark.read.parquet(path).select(L("step").alias("step"), "metric", r6(F.col("value"), "value"))


ORACLE["metric_log_table"] = ("SELECT step, 'eval/word_edit_rate' AS metric, word_edit_rate AS value FROM (" + ORACLE["word_edit_rate"] + ")")


# ------------------------------------------------------------ heavy families
def _step_vectors(spark, sf_dir):
    """Candidates of each step lack one token in four; references are shared."""
    t = V.token_vectors(spark, sf_dir)
    steps = t.where("side = 'cand'").withColumn("step", F.explode(F.array(*[F.lit(s) for s in V.STEPS])))
    return steps.where((F.col("tok") + F.col("step")) % 4 != 0).unionByName(
        t.where("side = 'ref'").withColumn("step", F.lit(None).cast("int")))


def _heavy(spark, sf_dir):
    scored = V.scored_refs(spark, sf_dir)
    versions = scored.withColumn("scorer", F.explode(F.array(F.lit("v1"), F.lit("v2")))).withColumn(
        "score", F.when(F.col("scorer") == "v2", -F.col("score")).otherwise(F.col("score")))
    best = align.best_per_owner(versions, ("scorer",), name="ext")
    return {"embedding": embedding.embedding_match_per_example(_step_vectors(spark, sf_dir), keys=KEYS), "external": best}


def _heavy_examples(spark, sf_dir):
    g = V.ref_groups(spark, sf_dir).select("example_id")
    return g.select(F.explode(F.array(*[F.lit(s) for s in V.STEPS])).alias("step"), "example_id")


_HEAVY = ("emb_precision", "emb_recall", "emb_f1", "ext@v1", "ext@v2")


@query("per_example_heavy")
def q_per_example_heavy(spark, sf_dir):
    """M7 to M9 + M13 + S9: heavy scores per step and example, two versions of a
    scorer side by side, written and read back; unscored examples stay."""
    examples = _heavy_examples(spark, sf_dir)
    per = EV.heavy_per_example(examples, _heavy(spark, sf_dir), KEYS)
    path = scratch_path(spark, "heavy") + "/outputs_eval-1.csv"
    io.write_heavy(EV.heavy_summary(per, KEYS), per, path, "parquet")
    back = spark.read.parquet(io.heavy_paths(path)[1])
    return back.select(L("step").alias("step"), L("example_id").alias("example_id"),
                       *[r6(F.col(f"`{c}`"), c.replace("@", "_"), 5) for c in _HEAVY])


@query("summary_heavy")
def q_summary_heavy(spark, sf_dir):
    """M7 to M10 + M12: heavy families beside a light metric, per step."""
    examples = _heavy_examples(spark, sf_dir)
    pairs = examples.withColumns({"prediction": F.lit("a b"), "references": F.array(F.lit("a c"))})
    w = EV.evaluate(pairs, KEYS, ["word_edit_rate"], heavy=_heavy(spark, sf_dir))
    return w.select(L("step").alias("step"), r6(F.col("word_edit_rate"), "word_edit_rate"),
                    *[r6(F.col(f"`{c}`"), c.replace("@", "_"), 5) for c in _HEAVY])


_HEAVY_CTES = [
    ("stv", """SELECT step, example_id, side, coalesce(ref_idx, -1) AS ref_idx, tok, list_transform(embedding, lambda x: x::DOUBLE /
                 sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u
               FROM token_vectors, (SELECT unnest([1, 2, 3]) AS step) WHERE side = 'ref' OR (tok + step) % 4 <> 0"""),
    ("ssim", """SELECT c.step, c.example_id, r.ref_idx, c.tok AS ct, r.tok AS rt,
                       list_sum(list_transform(range(1, len(c.u) + 1), lambda i: c.u[i] * r.u[i])) AS s
                FROM stv c JOIN stv r ON c.step = r.step AND c.example_id = r.example_id AND c.side = 'cand' AND r.side = 'ref'"""),
    ("spp", "SELECT step, example_id, ref_idx, avg(m) AS p FROM (SELECT step, example_id, ref_idx, ct, max(s) AS m FROM ssim GROUP BY ALL) GROUP BY ALL"),
    ("srr", "SELECT step, example_id, ref_idx, avg(m) AS r FROM (SELECT step, example_id, ref_idx, rt, max(s) AS m FROM ssim GROUP BY ALL) GROUP BY ALL"),
    ("semb", """SELECT step, example_id, max(p) AS emb_precision, max(r) AS emb_recall,
                       max(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) AS emb_f1
                FROM spp JOIN srr USING (step, example_id, ref_idx) GROUP BY ALL"""),
    ("sext", "SELECT example_id, max(score) AS v1, max(-score) AS v2 FROM scored_refs GROUP BY ALL"),
    ("hper", """SELECT step, example_id, emb_precision, emb_recall, emb_f1, v1, v2
                FROM (SELECT step, example_id FROM ref_groups, (SELECT unnest([1, 2, 3]) AS step))
                LEFT JOIN semb USING (step, example_id) LEFT JOIN sext USING (example_id)"""),
]

ORACLE["per_example_heavy"] = with_views(["ref_groups", "scored_refs", "token_vectors"], """
SELECT step::BIGINT AS step, example_id::BIGINT AS example_id, round(emb_precision, 5) AS emb_precision,
       round(emb_recall, 5) AS emb_recall, round(emb_f1, 5) AS emb_f1, round(v1, 5) AS ext_v1, round(v2, 5) AS ext_v2
FROM hper""", extra=_HEAVY_CTES)

ORACLE["summary_heavy"] = with_views(["ref_groups", "scored_refs", "token_vectors"], """
SELECT step::BIGINT AS step, 50.0 AS word_edit_rate, round(avg(emb_precision), 5) AS emb_precision, round(avg(emb_recall), 5) AS emb_recall,
       round(avg(emb_f1), 5) AS emb_f1, round(avg(v1), 5) AS ext_v1, round(avg(v2), 5) AS ext_v2
FROM hper GROUP BY step""", extra=_HEAVY_CTES)


# ------------------------------------------------------------ user functions, tokens
@query("pair_scores")
def q_pair_scores(spark, sf_dir):
    """M8 + M9: a user scorer over Arrow batches of (prediction, reference)."""
    pairs = V.eval_pairs(spark, sf_dir)
    scored = external.score_pairs(pairs, lambda p: (p["prediction"].str.len() - p["reference"].str.len()).abs() * -1.0, KEYS)
    best = align.best_per_owner(scored, KEYS)
    return best.select(L("step").alias("step"), L("example_id").alias("example_id"), "score")


ORACLE["pair_scores"] = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, example_id::BIGINT AS example_id, max(-abs(length(prediction) - length(r))::DOUBLE) AS score
FROM (SELECT step, example_id, prediction, unnest("references") AS r FROM eval_pairs) GROUP BY ALL""")


@query("row_function")
def q_rowfn(spark, sf_dir):
    """T8 + U1: a user function over batches of rows."""
    d = V.table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    out = rowfn.map_batches(d, lambda p: p.assign(n_words=p["text"].str.split().str.len())[["conv_id", "turn", "n_words"]],
                            "conv_id long, turn long, n_words long")
    return out


ORACLE["row_function"] = f"SELECT conv_id, turn, len({S.words('text')})::BIGINT AS n_words FROM conversations"


@query("tuple_predictions")
def q_tuple(spark, sf_dir):
    """Predictions that are tuples keep their first element."""
    t = V.eval_preds(spark, sf_dir).select("step", "example_id", F.struct(
        TX.split_ws("prediction").alias("words"), F.array(F.col("step")).alias("scores")).alias("prediction"))
    return tokens.first_of_tuple(t, "prediction").select(L("step").alias("step"), L("example_id").alias("example_id"),
                                                         sj(F.col("prediction")).alias("words"))


ORACLE["tuple_predictions"] = with_views(["eval_preds"], f"""
SELECT step::BIGINT AS step, example_id::BIGINT AS example_id, array_to_string({S.words('prediction')}, ' ') AS words FROM eval_preds""")


def _mean_words(pairs, keys, name):
    return pairs.groupBy(*keys).agg(F.avg(F.size(TX.split_ws("prediction"))).alias(name))


@query("generated_ids")
def q_generated(spark, sf_dir):
    """U2 + U3: generated ids decoded and scored, a registered user metric beside
    the built-in ones, generated length."""
    EV.register_metric("mean_words", _mean_words)
    voc = tokens.build_vocab(V.table(spark, sf_dir, "documents", ["text"]), "text", 500)
    p = V.eval_preds(spark, sf_dir).withColumns({"input": F.col("prediction"), "target": F.lit("")})
    ids = tokens.encode(p, voc, None, None, keys=(*KEYS, "example_id")).select(*KEYS, "example_id", F.col("input_ids").alias("pred_ids"))
    w = EV.evaluate_ids(ids, V.eval_refs(spark, sf_dir), voc, KEYS, ["word_edit_rate", "mean_words"])
    return w.select(L("step").alias("step"), r6(F.col("mean_words"), "mean_words"), r6(F.col("gen_len"), "gen_len"),
                    r6(F.col("word_edit_rate"), "word_edit_rate"))


# reserved ids, the unknown one among them, are not decoded: the predictions that are scored hold the known words alone
ORACLE["generated_ids"] = with_views(["eval_refs"], """
SELECT step, mean_words, gen_len, word_edit_rate FROM (""" + O.WORD_EDIT_RATE + """) JOIN (
  SELECT step::BIGINT AS step, round(avg(known), 6) AS mean_words, round(avg(n + 1), 6) AS gen_len FROM known GROUP BY step) USING (step)""", extra=[
    O._VOCAB, ("raw_preds", S.VIEWS["eval_preds"][1]), ("placed", """
SELECT step, example_id, len(w) AS n, unnest(CASE WHEN len(w) > 0 THEN w ELSE [NULL] END) AS token,
       generate_subscripts(CASE WHEN len(w) > 0 THEN w ELSE [NULL] END, 1) AS pos
FROM (SELECT step, example_id, """ + S.words("prediction") + """ AS w FROM raw_preds)"""), ("known", """
SELECT step, example_id, any_value(n) AS n, count(v.token) AS known, coalesce(string_agg(v.token, ' ' ORDER BY pos), '') AS prediction
FROM placed p LEFT JOIN vocab v ON v.token = p.token AND v.id > 3 GROUP BY step, example_id"""), ("eval_pairs", """
SELECT k.step, k.example_id, k.prediction, r."references" FROM known k LEFT JOIN eval_refs r USING (example_id)""")])


@query("encode_flattened")
def q_encode_flattened(spark, sf_dir):
    """T2 after P7: several pairs of one example, a vocabulary of 50,000."""
    pairs = recipes.flatten_all(recipes.linearise_triples(recipes.filter_lexicalizations(
        V.ref_groups(spark, sf_dir), V.REF_TARGET_LANG, V.REF_LEX_SOURCE)))
    voc = tokens.build_vocab(V.table(spark, sf_dir, "documents", ["text"]), "text", 50_000)
    e = tokens.encode(pairs, voc, 1024, None)
    return e.select(L("example_id").alias("example_id"), sj(F.col("input_ids")).alias("input_ids"), sj(F.col("labels")).alias("labels"))


_K50 = (O._VOCAB[0], O._VOCAB[1].replace("LIMIT 500", "LIMIT 50000").replace(
    O._langs, ", ".join(f"('{t}', {len(tokens.SPECIALS) + 50_000 + i})" for i, t in enumerate(tokens.lang_tokens()))))

ORACLE["encode_flattened"] = with_views(["ref_filtered"], """
SELECT example_id::BIGINT AS example_id, array_to_string(wi, ' ') AS input_ids, array_to_string(wt, ' ') AS labels
FROM (SELECT any_value(example_id) AS example_id,
             list_concat(list(coalesce(id, 2) ORDER BY pos) FILTER (side = 0), [1]) AS wi,
             list_concat(coalesce(list(coalesce(id, 2) ORDER BY pos) FILTER (side = 1), []), [1]) AS wt
      FROM ftok LEFT JOIN vocab USING (token) GROUP BY rid)""", extra=[_K50, ("flat", f"""
SELECT row_number() OVER () AS rid, example_id, {S.words("input")} AS wi, {S.words("target")} AS wt FROM (
  SELECT example_id, {O._LIN} AS input, unnest(lex) AS target FROM ref_filtered)"""), ("ftok", """
SELECT rid, example_id, 0 AS side, unnest(wi[1:1023]) AS token, generate_subscripts(wi[1:1023], 1) AS pos FROM flat
UNION ALL SELECT rid, example_id, 1, unnest(wt), generate_subscripts(wt, 1) FROM flat""")])


@query("dedup_one_run")
def q_dedup_one_run(spark, sf_dir):
    """D1 where one run holds every row."""
    d = align.dedup_recent_sources(V.dedup_stream(spark, sf_dir).withColumn("run", F.lit(0)), order_col="prediction")
    return d.select(L("prediction").alias("prediction"), "source")


ORACLE["dedup_one_run"] = with_views(["dedup_stream"], """
SELECT k.id::BIGINT AS prediction, d.source FROM (
  SELECT unnest(list_reduce(list({'id': prediction, 's': source} ORDER BY prediction), lambda a, x: CASE
           WHEN list_contains(a.r, x.s) THEN a ELSE {'kept': list_append(a.kept, x.id), 'r': list_append(a.r, x.s)[-3:]} END,
         {'kept': []::BIGINT[], 'r': []::VARCHAR[]}).kept) AS id FROM dedup_stream) k
JOIN dedup_stream d ON d.prediction = k.id""")

"""Registered queries: one per operator of the inventory, each
``(spark, sf_dir) -> DataFrame`` over the driver tables (via the views).

Outputs are flat (string / bigint / double columns): list-valued results are
serialised with ``array_join`` so that they compare exactly with the SQL twins
in ``lexeval.plans.oracle``.  Floating results are rounded to 6 decimals
(embedding scores to 5).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexeval.functions import text as TX
from lexeval.metrics import embedding, external, ngram, sequence
from lexeval.operators import align, recipes, tokens
from lexeval.plans import evaluate as EV
from lexeval.plans import views as V

KEYS = ["step"]
QUERIES: dict = {}
SEP = " ||| "

# Fixed query parameters (shared with the SQL twins).
SUBSET_LIMITS = {"train": 50, "validation": 10, "test": None}
VOCAB_K = 500
# Metrics of the summary queries with an SQL twin; ``summary_full`` has TER as well.
SUMMARY = ["BLEU", "BLEU_lower", "chrF++", "rougeL", "meteor", "gen_len"]
MAX_SRC, MAX_TGT = 1024, 128
BATCH = 8


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c, name, d=6):
    return F.round(c, d).alias(name)


def sj(c, sep=" "):
    """Serialise an array column to one string."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def L(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# ============================================================ sources / recipes
@query("subset_head")
def q_subset_head(spark, sf_dir):
    """First n examples per split, before any flattening."""
    s = recipes.select_subset(V.splits(spark, sf_dir).select("example_id", "split"), SUBSET_LIMITS)
    return s.select(L("example_id").alias("example_id"), "split")


@query("dialogue_pairs")
def q_dialogue_pairs(spark, sf_dir):
    """P1 via the recipe registry (P10)."""
    p = recipes.prepare(V.dialogue_acts(spark, sf_dir), "cs_restaurants")["pairs"]
    return p.select(L("example_id").alias("example_id"), "split", "input", "target")


@query("translation_pairs")
def q_translation_pairs(spark, sf_dir):
    """P3 via the recipe registry (P10); the translation struct is kept."""
    p = recipes.prepare(V.translations(spark, sf_dir), "wmt19")["pairs"]
    return p.select(L("example_id").alias("example_id"), "split", "input", "target",
                    F.col("translation.cs").alias("translation_cs"))


@query("lex_filter")
def q_lex_filter(spark, sf_dir):
    """References of the target language from a matching source."""
    f = recipes.filter_lexicalizations(V.ref_groups(spark, sf_dir), V.REF_TARGET_LANG, V.REF_LEX_SOURCE)
    return f.select(L("example_id").alias("example_id"), L(F.size("lex")).alias("n_refs"),
                    F.array_join("lex", SEP).alias("refs_text"))


@query("linearise_triples")
def q_linearise(spark, sf_dir):
    """P5: the single triple set joined with ' - '."""
    return recipes.linearise_triples(V.triple_sets(spark, sf_dir)).select(
        L("example_id").alias("example_id"), "input")


def _web_nlg(spark, sf_dir):
    return recipes.prepare(V.ref_groups(spark, sf_dir), "web_nlg", target_lang=V.REF_TARGET_LANG,
                           lex_source=V.REF_LEX_SOURCE)


@query("multi_reference")
def q_multi_reference(spark, sf_dir):
    """The multi-reference branch of the triples recipe."""
    m = _web_nlg(spark, sf_dir)["multi_reference"]
    return m.select(L("example_id").alias("example_id"), "split", "input",
                    L(F.size("references")).alias("n_refs"), F.array_join("references", SEP).alias("refs_text"))


@query("flatten_first")
def q_flatten_first(spark, sf_dir):
    """(input, first reference); examples without references vanish."""
    p = recipes.linearise_triples(recipes.filter_lexicalizations(
        V.ref_groups(spark, sf_dir), V.REF_TARGET_LANG, V.REF_LEX_SOURCE))
    return recipes.flatten_first(p).select(L("example_id").alias("example_id"), "input", "target")


@query("flatten_all")
def q_flatten_all(spark, sf_dir):
    """One row per (input, reference)."""
    p = recipes.linearise_triples(recipes.filter_lexicalizations(
        V.ref_groups(spark, sf_dir), V.REF_TARGET_LANG, V.REF_LEX_SOURCE))
    return recipes.flatten_all(p).select(L("example_id").alias("example_id"), "input", "target")


@query("flatten_by_split")
def q_flatten_by_split(spark, sf_dir):
    """P6 + P7 + P10: train split flattened to all references, others to the first."""
    p = _web_nlg(spark, sf_dir)["pairs"]
    return p.select(L("example_id").alias("example_id"), "split", "input", "target")


# ============================================================ alignment / arrays
@query("flatten_references")
def q_flatten_refs(spark, sf_dir):
    """A1: one row per (example, reference) with its index."""
    f = align.flatten_references(V.eval_refs(spark, sf_dir), carry=("source",))
    return f.select(L("example_id").alias("example_id"), "source", L("ref_idx").alias("ref_idx"), "reference")


@query("pad_references")
def q_pad_refs(spark, sf_dir):
    """A2: ragged reference lists padded with '' to the longest list."""
    p = align.pad_references(V.eval_refs(spark, sf_dir))
    return p.select(L("example_id").alias("example_id"), L(F.size("references")).alias("n_refs"),
                    F.array_join("references", SEP).alias("refs_text"))


@query("max_references")
def q_max_refs(spark, sf_dir):
    """The maximum number of references per example."""
    return align.max_reference_count(V.eval_refs(spark, sf_dir)).select(L("max_references").alias("max_references"))


@query("best_per_owner")
def q_best_per_owner(spark, sf_dir):
    """A3 / M8 / M9 per example: best external score over an example's
    references; examples with no reference get NULL."""
    examples = V.ref_groups(spark, sf_dir).select("example_id")
    per = external.external_per_example(V.scored_refs(spark, sf_dir), examples, name="best_score")
    return per.select(L("example_id").alias("example_id"), r6(F.col("best_score"), "best_score"))


@query("external_score")
def q_external_score(spark, sf_dir):
    """Mean of the per-example best scores."""
    examples = V.ref_groups(spark, sf_dir).select("example_id")
    per = external.external_per_example(V.scored_refs(spark, sf_dir), examples, name="score")
    return external.external_summary(per, name="score").select(r6(F.col("score"), "score"))


@query("align_examples")
def q_align(spark, sf_dir):
    """Predictions of every step joined with the shared references."""
    a = align.align(V.eval_preds(spark, sf_dir), V.eval_refs(spark, sf_dir))
    return a.select(L("step").alias("step"), L("example_id").alias("example_id"), "prediction", "source",
                    L(F.size("references")).alias("n_refs"))


def _altered_outputs(df):
    m = F.pmod(F.col("example_id"), F.lit(7))
    return df.where(F.pmod(F.col("example_id"), F.lit(11)) != 5).select(
        "example_id", F.when(m == 3, F.concat(F.col("input"), F.lit(" (edited)"))).otherwise(F.col("input"))
        .alias("source"))


@query("alignment_report")
def q_alignment_report(spark, sf_dir):
    """Examples whose output source differs from the dataset input."""
    inputs = recipes.linearise_triples(V.ref_groups(spark, sf_dir)).select("example_id", "input")
    rep = align.alignment_report(_altered_outputs(inputs), inputs)
    return rep.select(L("example_id").alias("example_id"), "expected", "got")


@query("dedup_recent")
def q_dedup(spark, sf_dir):
    """Window-of-3 order-preserving de-duplication per run."""
    d = align.dedup_recent_sources(V.dedup_stream(spark, sf_dir))
    return d.select(L("run").alias("run"), L("prediction").alias("prediction"), "source")


# ============================================================ metrics
@query("bleu")
def q_bleu(spark, sf_dir):
    b = ngram.corpus_bleu(V.eval_pairs(spark, sf_dir), KEYS, lowercase=False, name="bleu")
    return b.select(L("step").alias("step"), r6(F.col("bleu"), "bleu"))


@query("bleu_lower")
def q_bleu_lower(spark, sf_dir):
    b = ngram.corpus_bleu(V.eval_pairs(spark, sf_dir), KEYS, lowercase=True, name="bleu_lower")
    return b.select(L("step").alias("step"), r6(F.col("bleu_lower"), "bleu_lower"))


@query("chrf_pp")
def q_chrf(spark, sf_dir):
    c = ngram.corpus_chrf(V.eval_pairs(spark, sf_dir), KEYS, name="chrf_pp")
    return c.select(L("step").alias("step"), r6(F.col("chrf_pp"), "chrf_pp"))


@query("chrf_per_example")
def q_chrf_ex(spark, sf_dir):
    c = ngram.chrf_stats(V.eval_pairs(spark, sf_dir), KEYS)
    return c.select(L("step").alias("step"), L("example_id").alias("example_id"), L("best_ref").alias("best_ref"),
                    r6(F.col("chrf"), "chrf"))


@query("ter")
def q_ter(spark, sf_dir):
    """M4: corpus TER with block shifts (brute-force twin in the tests: greedy shift search)."""
    t = sequence.ter(V.eval_pairs(spark, sf_dir), KEYS, name="ter")
    return t.select(L("step").alias("step"), r6(F.col("ter"), "ter"))


@query("word_edit_rate")
def q_wer(spark, sf_dir):
    """M4 without shifts: corpus word edit rate."""
    t = sequence.word_edit_rate(V.eval_pairs(spark, sf_dir), KEYS, name="word_edit_rate")
    return t.select(L("step").alias("step"), r6(F.col("word_edit_rate"), "word_edit_rate"))


@query("rouge_l")
def q_rouge(spark, sf_dir):
    """M5: mean best-reference ROUGE-L F1."""
    r = sequence.rouge_l(V.eval_pairs(spark, sf_dir), KEYS, name="rougeL")
    return r.select(L("step").alias("step"), r6(F.col("rougeL"), "rougeL"))


@query("rouge_l_per_example")
def q_rouge_ex(spark, sf_dir):
    r = sequence.rouge_l_per_example(V.eval_pairs(spark, sf_dir), KEYS)
    return r.select(L("step").alias("step"), L("example_id").alias("example_id"),
                    r6(F.col("rougeL_precision"), "rougeL_precision"), r6(F.col("rougeL_recall"), "rougeL_recall"),
                    r6(F.col("rougeL"), "rougeL"))


@query("meteor")
def q_meteor(spark, sf_dir):
    """M6: mean best-reference exact-match METEOR."""
    m = sequence.meteor(V.eval_pairs(spark, sf_dir), KEYS, name="meteor")
    return m.select(L("step").alias("step"), r6(F.col("meteor"), "meteor"))


@query("meteor_per_example")
def q_meteor_ex(spark, sf_dir):
    m = sequence.meteor_per_example(V.eval_pairs(spark, sf_dir), KEYS)
    return m.select(L("step").alias("step"), L("example_id").alias("example_id"), r6(F.col("meteor"), "meteor"))


@query("meteor_stem")
def q_meteor_stem(spark, sf_dir):
    """M6 with its stem stage beside the exact one, in one pass; every third word
    of a prediction takes an inflection, which only stems see through."""
    inflected = F.transform(TX.split_ws("prediction"), lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit("s"))).otherwise(x))
    pairs = V.eval_pairs(spark, sf_dir).withColumn("prediction", F.array_join(inflected, " "))
    m = EV.evaluate(pairs, KEYS, {"meteor": {}, "meteor_stem": ("meteor", {"stem": True})})
    return m.select(L("step").alias("step"), r6(F.col("meteor"), "meteor"), r6(F.col("meteor_stem"), "meteor_stem"))


@query("embedding_match")
def q_emb(spark, sf_dir):
    """M7: greedy cosine matching of token embeddings (P, R, F1 means)."""
    e = embedding.embedding_match(V.token_vectors(spark, sf_dir))
    return e.select(*[r6(F.col(c), c, 5) for c in ("emb_precision", "emb_recall", "emb_f1")])


@query("embedding_per_example")
def q_emb_ex(spark, sf_dir):
    e = embedding.embedding_match_per_example(V.token_vectors(spark, sf_dir))
    return e.select(L("example_id").alias("example_id"),
                    *[r6(F.col(c), c, 5) for c in ("emb_precision", "emb_recall", "emb_f1")])


# ============================================================ reports
@query("summary_wide")
def q_summary(spark, sf_dir):
    """One row per step, one column per selected metric."""
    w = EV.evaluate(V.eval_pairs(spark, sf_dir), KEYS, SUMMARY)
    return w.select(L("step").alias("step"), *[r6(F.col(m), m) for m in SUMMARY])


@query("summary_full")
def q_summary_full(spark, sf_dir):
    """Every light metric, TER with shifts included, and the generated
    length, of all steps in one pass."""
    metrics = [*EV.LIGHT, "gen_len"]
    w = EV.evaluate(V.eval_pairs(spark, sf_dir), KEYS, metrics)
    return w.select(L("step").alias("step"), *[r6(F.col(m), m) for m in metrics])


@query("metric_log")
def q_metric_log(spark, sf_dir):
    """Step-keyed long metric log with the 'eval/' prefix."""
    w = EV.evaluate(V.eval_pairs(spark, sf_dir), KEYS, SUMMARY)
    lg = EV.metric_log(w, KEYS, SUMMARY)
    return lg.select(L("step").alias("step"), "metric", r6(F.col("value"), "value"))


@query("per_example")
def q_per_example(spark, sf_dir):
    """Per-example table of sources, predictions, references and
    per-example scores."""
    pe = EV.per_example(V.eval_pairs(spark, sf_dir), KEYS)
    return pe.select(L("step").alias("step"), L("example_id").alias("example_id"), "source", "prediction",
                     F.array_join("references", SEP).alias("refs_text"), r6(F.col("chrf"), "chrf"),
                     r6(F.col("meteor"), "meteor"))


@query("run_keys")
def q_run_keys(spark, sf_dir):
    """Run key from a model name, file suffix, heavy-output path."""
    d = V.table(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    model = F.concat(F.lit("org-"), F.col("source"), F.lit("/model-"), F.col("lang"))
    path = F.concat(F.lit("runs/"), F.col("source"), F.lit("/outputs_eval-"), F.col("doc_id").cast("string"),
                    F.lit(".csv"))
    return d.select(L("doc_id").alias("doc_id"), TX.run_key(model).alias("run_key"),
                    TX.file_suffix(path).alias("suffix"),
                    F.regexp_replace(path, r"\.csv$", "_heavy_overall.csv").alias("heavy_path"))


# ============================================================ tokens
def _vocab(spark, sf_dir):
    return tokens.build_vocab(V.table(spark, sf_dir, "documents", ["text"]), "text", VOCAB_K)


def _token_source(spark, sf_dir):
    """Documents as (input, target) pairs: input = text, target = text."""
    d = V.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("example_id"), F.col("text").alias("input"), F.col("text").alias("target"))


@query("vocab")
def q_vocab(spark, sf_dir):
    """Specials, top-k corpus words (count desc, word), language codes."""
    return _vocab(spark, sf_dir).select("token", L("id").alias("id"))


@query("encode_padded")
def q_encode_padded(spark, sf_dir):
    """T2 + A4 + A5 + A6: lookup, truncation, max-length padding, attention
    mask, label masking."""
    e = tokens.encode(V.translations(spark, sf_dir).transform(recipes.translation_pairs), _vocab(spark, sf_dir),
                      MAX_SRC, MAX_TGT, padding="max_length", ignore_pad_token_for_loss=True)
    return e.select(L("example_id").alias("example_id"), sj(F.col("input_ids")).alias("input_ids"),
                    sj(F.col("attention_mask")).alias("attention_mask"), sj(F.col("labels")).alias("labels"))


@query("encode_unpadded")
def q_encode_unpadded(spark, sf_dir):
    """T2 + A4 without padding (label ids never masked)."""
    e = tokens.encode(_token_source(spark, sf_dir), _vocab(spark, sf_dir), MAX_SRC, MAX_TGT, padding=False)
    return e.select(L("example_id").alias("example_id"), sj(F.col("input_ids")).alias("input_ids"),
                    sj(F.col("labels")).alias("labels"))


@query("collate_batches")
def q_collate(spark, sf_dir):
    """Dynamic padding to the longest row of each batch of 8, rounded up
    to a multiple of 8."""
    e = tokens.encode(_token_source(spark, sf_dir), _vocab(spark, sf_dir), MAX_SRC, MAX_TGT, padding=False)
    e = e.withColumn("batch_id", F.floor(F.col("example_id") / BATCH))
    c = tokens.collate(e, "batch_id", pad_to_multiple_of=8)
    return c.select(L("example_id").alias("example_id"), L("batch_id").alias("batch_id"),
                    sj(F.col("input_ids")).alias("input_ids"), sj(F.col("attention_mask")).alias("attention_mask"),
                    sj(F.col("labels")).alias("labels"))


@query("decoder_inputs")
def q_decoder_inputs(spark, sf_dir):
    """Labels shifted right behind the start id, -100 → pad."""
    e = tokens.encode(V.translations(spark, sf_dir).transform(recipes.translation_pairs), _vocab(spark, sf_dir),
                      MAX_SRC, MAX_TGT, padding="max_length", ignore_pad_token_for_loss=True)
    return e.select(L("example_id").alias("example_id"),
                    sj(tokens.decoder_inputs(F.col("labels"))).alias("decoder_input_ids"))


@query("decode")
def q_decode(spark, sf_dir):
    """T3 + T4: ids back to text without special ids, stripped."""
    voc = _vocab(spark, sf_dir)
    e = tokens.encode(V.translations(spark, sf_dir).transform(recipes.translation_pairs), voc, None, None)
    return tokens.decode(e, "labels", voc).select(L("example_id").alias("example_id"), "text")


@query("gen_len")
def q_gen_len(spark, sf_dir):
    """T5: mean count of non-pad ids of generated predictions, per step."""
    voc = _vocab(spark, sf_dir)
    p = V.eval_preds(spark, sf_dir).select("step", "example_id", F.col("prediction").alias("input"),
                                           F.col("prediction").alias("target"))
    e = tokens.encode(p, voc, None, None, keys=("step", "example_id"))
    g = e.groupBy("step").agg(F.avg(tokens.gen_len(F.col("input_ids"))).alias("gen_len"))
    return g.select(L("step").alias("step"), r6(F.col("gen_len"), "gen_len"))


@query("lang_tag")
def q_lang_tag(spark, sf_dir):
    """Target-language id forced as the first label id, per model family."""
    voc = _vocab(spark, sf_dir)
    fams = list(tokens.LANG_CODES)
    t = V.translations(spark, sf_dir).transform(recipes.translation_pairs)
    e = tokens.encode(t, voc, None, None)
    e = e.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in fams]),
                                            (F.pmod("example_id", F.lit(len(fams))) + 1).cast("int")))
    tagged = tokens.force_target_language(e, tokens.lang_table(spark, voc))
    return tagged.select(L("example_id").alias("example_id"), "family", sj(F.col("labels")).alias("labels"))

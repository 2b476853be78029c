"""Metric identities, edge cases, and brute-force checks of the queries that
have no SQL twin."""
import pytest
from pyspark.sql import functions as F

from lexeval.metrics import ngram, sequence
from lexeval.operators.kernels import lcs_len, ter_edits
from lexeval.plans import evaluate as EV
from lexeval.plans import queries, views

SCHEMA = "step int, example_id long, prediction string, references array<string>"


def _one(spark, pred, refs):
    return spark.createDataFrame([(1, 0, pred, refs)], SCHEMA)


def test_identity_scores(spark):
    s = "The quick brown fox jumps over the lazy dog ."
    df = _one(spark, s, [s, "something else entirely"])
    assert abs(ngram.corpus_bleu(df, ["step"]).first().bleu - 100) < 1e-9
    assert abs(ngram.corpus_chrf(df, ["step"]).first().chrf_pp - 100) < 1e-9
    assert sequence.ter(df, ["step"]).first().ter == 0.0
    assert sequence.rouge_l(df, ["step"]).first().rougeL == 1.0


def test_bleu_edges(spark):
    assert ngram.corpus_bleu(_one(spark, "", ["a b c d"]), ["step"]).first().bleu == 0.0
    smoothed = ngram.corpus_bleu(_one(spark, "a b c d e", ["a b c x e"]), ["step"]).first().bleu
    assert 0 < smoothed < 100
    # padding with "" changes nothing
    a = ngram.corpus_bleu(_one(spark, "a b c d e f", ["a b c d x f"]), ["step"]).first().bleu
    b = ngram.corpus_bleu(_one(spark, "a b c d e f", ["a b c d x f", "", ""]), ["step"]).first().bleu
    assert a == b


def test_more_references_never_hurt_rouge(spark):
    one = sequence.rouge_l(_one(spark, "a b c d", ["a x c"]), ["step"]).first().rougeL
    two = sequence.rouge_l(_one(spark, "a b c d", ["a x c", "a b c"]), ["step"]).first().rougeL
    assert two >= one


def test_ter_and_rouge_queries_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    pairs = views.eval_pairs(spark, sf).collect()
    got_ter = {r.step: r.ter for r in queries.QUERIES["ter"](spark, sf).collect()}
    got_rouge = {(r.step, r.example_id): r.rougeL for r in queries.QUERIES["rouge_l_per_example"](spark, sf).collect()}
    import re
    edits, lens = {}, {}
    assert any(not any(p.references) for p in pairs)
    for p in pairs:
        h = p.prediction.lower().split()
        refs = [r.lower().split() for r in p.references if r]
        if not refs:  # takes part in no score
            assert got_rouge[(p.step, p.example_id)] is None
            continue
        edits[p.step] = edits.get(p.step, 0) + min(ter_edits(h, r) for r in refs)
        lens[p.step] = lens.get(p.step, 0) + sum(len(r) for r in refs) / len(refs)
        tok = lambda t: [x for x in re.sub("[^a-z0-9]+", " ", t.lower()).split() if x]
        best = 0.0
        for r in p.references:
            hh, rr = tok(p.prediction), tok(r)
            lcs = lcs_len(rr, hh)
            if hh and rr and lcs:
                pr, rc = lcs / len(hh), lcs / len(rr)
                best = max(best, 2 * pr * rc / (pr + rc))
        assert abs(got_rouge[(p.step, p.example_id)] - round(best, 6)) < 1e-6
    for s in edits:
        assert abs(got_ter[s] - round(100 * edits[s] / lens[s], 6)) < 1e-6


def test_meteor_stem_stage_equals_a_join_on_a_table_of_stems(spark, sf="/root/testdata/sf0.001"):
    """The stems of every token, looked up by a join, against the stage in the kernel."""
    from lexeval.functions.text import meteor_tokens
    from lexeval.operators.stem import stem
    pairs = views.eval_pairs(spark, sf).where("step = 1").withColumn("prediction", F.array_join(
        F.transform(F.split("prediction", " "), lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit("s"))).otherwise(x)), " "))
    tokens = pairs.select(F.explode(F.flatten(F.array(meteor_tokens("prediction"), meteor_tokens(F.array_join("references", " ")))))).distinct()
    table = spark.createDataFrame([(r[0], stem(r[0])) for r in tokens.collect()], "token string, cls string")
    by_join = {r.example_id: r.meteor for r in sequence.meteor_per_example(pairs, ["step"], classes=table).collect()}
    by_kernel = {r.example_id: r.meteor for r in sequence.meteor_per_example(pairs, ["step"], stem=True).collect()}
    exact = {r.example_id: r.meteor for r in sequence.meteor_per_example(pairs, ["step"]).collect()}
    assert by_join == by_kernel and sum((by_kernel[k] or 0) > (exact[k] or 0) for k in exact) > len(exact) / 2
    one = _one(spark, "the cats sat", ["the cat sat"])
    for fused in (True, False):
        got = EV.evaluate(one, ["step"], {"m": ("meteor", {"stem": True}), "meteor": {}}, fused=fused).first()
        assert abs(got.m - (1 - 0.5 * (1 / 3) ** 3)) < 1e-12 and got.meteor < got.m
    with pytest.raises(ValueError):
        sequence.meteor(one, ["step"], classes=table, stem=True)


def test_meteor_class_stage(spark):
    df = _one(spark, "the cats sat", ["the cat sat"])
    exact = sequence.meteor(df, ["step"]).first().meteor
    classes = spark.createDataFrame([("cats", "cat"), ("cat", "cat")], "token string, cls string")
    staged = sequence.meteor(df, ["step"], classes=classes).first().meteor
    assert staged > exact
    # all three words aligned in one chunk: (1 - 0.5 * (1/3)^3) * 1
    assert abs(staged - (1 - 0.5 * (1 / 3) ** 3)) < 1e-12


def test_evaluate_ids_decodes_and_scores(spark):
    from lexeval.operators import tokens
    from lexeval.plans.evaluate import evaluate_ids
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens.SPECIALS + ["a", "b", "c", "d"])],
                                  "token string, id int")
    gen = spark.createDataFrame([(1, 0, [3, 4, 5, 6, 7, 1, 0, 0])], "step int, example_id long, pred_ids array<int>")
    refs = spark.createDataFrame([(0, ["a b c d"])], "example_id long, references array<string>")
    r = evaluate_ids(gen, refs, vocab, metrics=["BLEU"]).first()
    assert abs(r.BLEU - 100) < 1e-9 and r.gen_len == 6


def test_fused_evaluation_equals_separate_families(spark):
    p = views.eval_pairs(spark, "/root/testdata/sf0.001")
    ms = ["BLEU", "BLEU_lower", "chrF++", "TER", "word_edit_rate", "rougeL", "meteor"]
    a = sorted(EV.evaluate(p, ["step"], ms).collect())
    b = sorted(EV.evaluate(p, ["step"], ms, fused=False).collect())
    assert len(a) == 3
    for x, y in zip(a, b):
        for m in ms:
            assert abs(x[m] - y[m]) < 1e-9, m


def test_empty_input_gives_one_row_of_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows = EV.evaluate(empty, [], ["BLEU", "chrF++", "TER", "rougeL", "meteor"]).collect()
    assert len(rows) == 1 and all(v is None for v in rows[0])


NO_REFERENCES = ([], None, [""], [None, ""])


@pytest.mark.parametrize("refs", NO_REFERENCES)
def test_an_example_without_references_counts_nowhere(spark, refs):
    ms = ["BLEU", "BLEU_lower", "chrF++", "TER", "word_edit_rate", "rougeL", "meteor"]
    text = "a b c d e f"
    rows = spark.createDataFrame([(1, 0, text, [text]), (1, 1, text, refs), (2, 2, text, refs)], SCHEMA)
    for fused in (True, False):
        got = {r.step: r for r in EV.evaluate(rows, ["step"], ms, fused=fused).collect()}
        perfect = EV.evaluate(rows.where("example_id = 0"), ["step"], ms, fused=fused).first()
        assert all(abs(got[1][m] - perfect[m]) < 1e-9 for m in ms), fused
        assert all(got[2][m] is None for m in ms), (fused, got[2])
    per = {r.example_id: r for r in EV.per_example(rows, ["step"]).collect()}
    assert per[1].chrf is None and per[1].meteor is None and per[0].chrf == 100


def test_chrf_of_other_orders(spark):
    from lexeval.operators.kernels import chrf_batch
    p = _one(spark, "abc d", ["abd c"])
    r = ngram.chrf_stats(p, ["step"], char_order=2, word_order=1).first()
    want = chrf_batch(["abcd"], [["abc", "d"]], [["abdc"]], [[["abd", "c"]]], 2, 1)[0][0]
    assert [x for s in r.stats for x in (s.h, s.r, s.m)] == want


def test_unicode_white_space_splits_words(spark):
    from lexeval.functions import text as TX
    t = "k\u00a0domu\u3000a\u2009b\x85c\x1cd"
    row = spark.createDataFrame([(t,)], "t string").select(
        TX.split_ws("t").alias("w"), TX.chrf_chars("t").alias("c"), TX.strip_ws(F.concat(F.lit("\u00a0"), "t")).alias("s"),
        TX.meteor_tokens("t").alias("m")).first()
    assert row.w == t.split() == row.m and row.c == "".join(t.split()) and row.s == t


def test_class_tables_of_any_size(spark):
    many = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("token"), F.lit("x").alias("cls"))
    many = many.union(spark.createDataFrame([("cats", "cat"), ("cat", "cat")], "token string, cls string"))
    df = _one(spark, "the cats sat", ["the cat sat"])
    assert abs(sequence.meteor(df, ["step"], classes=many).first().meteor - (1 - 0.5 * (1 / 3) ** 3)) < 1e-12

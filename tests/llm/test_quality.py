"""Quality rules against plain Python statistics, the SQL twin and edge cases."""

import random

from lexeval.llm.queries import ORACLE, QUERIES
from lexeval.llm.quality import filter_documents, quality_rules, statistics
from tests.llm.brute import spaced_words
from tests.oracle_check import compare


def brute(text):
    text = text or ""
    w = spaced_words(text)
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if spaced_words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "\x0bx\x0c y\r\n\nx\nx\n x", "é\U0001f600#  &&",
           "z " * 40, " ".join("w%d" % rng.randrange(9) for _ in range(20000)), "line one\nline two\nline one\n\n\n"]
    for _ in range(80):
        w = [rng.choice(["alpha", "b", "cé", "#d", "<e>"]) + str(rng.randrange(300)) for _ in range(rng.randrange(120))]
        at = rng.randrange(len(w) + 1)
        out.append(rng.choice([" ", "\n", "  "]).join(w + w[at:at + rng.randrange(30)]))
    return out


def test_statistics_against_plain_python(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n long")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in statistics(df).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_thresholds_follow_the_group(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(max(1, int(rng.gauss(n, 1))))) for _ in range(60))
    rows = [(i, text(5), "en", "web", "x") for i in range(200)] + [(200 + i, text(12), "de", "law", "x") for i in range(150)]
    rows += [(400, text(12), "en", "web", "x"), (401, text(5), "de", "law", "x"), (402, text(5), "en", None, "x"),
             (403, " ".join("ab|||##" for _ in range(3)) + text(5), "en", "web", "x"), (404, text(5), None, "web", "x"), (405, None, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, t_word_length string").repartition(7)
    kept = {r.doc_id for r in quality_rules(df).where("kept").collect()}
    assert set(range(350)) <= kept
    assert not kept & {400, 401, 403, 405} and {402, 404} <= kept
    rows = filter_documents(df).collect()
    assert {r.doc_id for r in rows} == kept and rows[0].t_word_length == "x"


def test_each_rule_rejects_texts_that_pass_the_base_rules(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcde") for _ in range(rng.choice([4, 5, 6]))) for _ in range(n)]
    plain = [" ".join(words(100)) for _ in range(200)]
    w, few = words(90), words(2)
    odd = {"word_length": " ".join(x + "ab" for x in words(100)), "symbol_share": " ".join(words(100)) + " #" * 12,
           "upper_share": " ".join(x.title() if i % 5 == 0 else x for i, x in enumerate(words(100))),
           "dup_line_share": "\n".join([" ".join(words(20)), *[" ".join(few)] * 2, " ".join(words(40))]),
           "repeat_share": " ".join(w[:10] + w)}
    rows = [(i, t, "en", "web") for i, t in enumerate(plain + list(odd.values()))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k: got[200 + i] for i, k in enumerate(odd)} == {k: (False, False) for k in odd}
    assert sum(got[i][1] for i in range(200)) >= 195


def test_empty_and_hopeless_tables(spark):
    df = spark.createDataFrame([(1, "too short", "en", "a"), (1, "too short", "en", "a")], "doc_id long, text string, lang string, source string")
    assert quality_rules(df.limit(0)).collect() == []
    assert [(r.base_failed, r.kept) for r in quality_rules(df).collect()] == [(True, False)] * 2


def test_texts_without_words_divide_nothing_by_zero(spark):
    rng = random.Random(6)
    plain = [" ".join("".join(rng.choice("abcde") for _ in range(rng.choice([4, 5, 6]))) for _ in range(60)) for _ in range(120)]
    rows = [(i, t, "en", "web") for i, t in enumerate([*plain, None, "", " \n\t "])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = quality_rules(df)
    assert judged.selectExpr("count(*)", "count_if(kept)", "count_if(base_failed)").first()[2] == 3
    assert {r.doc_id: (r.base_failed, r.kept) for r in judged.where("doc_id >= 120").collect()} == dict.fromkeys([120, 121, 122], (True, False))


def test_query_matches_sql(spark):
    info = compare(spark, "/root/testdata/sf0.01", "op1", QUERIES["op1_quality"], ORACLE["op1_quality"])
    assert info["ok"], info

"""URL filter: parsing, rules, the model against plain Python, the SQL twin."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lexeval.llm import urlfilter as U
from lexeval.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare


def test_hosts_paths_and_rules(spark):
    cases = [("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
             ("https://b.net/de", "b.net", "/de", "net/", "block"), ("https://b.net", "b.net", "", None, None),
             ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
             ("https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
             ("ftp://x.org?u=http://y.net/", "x.org", "", None, None), ("x.org/fr/", "", "", None, None),
             ("http://q.org/fr/a\nb", "q.org", "/fr/a\nb", "org/fr/", "allow"), (None, "", "", None, None), ("", "", "", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    rows = {r.page_id: r for r in U.filter_urls(df.withColumn("rule", F.lit(1))).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), cases[i]
        assert verdict in (None, rows[i].verdict)
        assert host or rows[i].verdict == "block"


def brute_scores(texts):
    """Witten-Bell interpolation over nested contexts, one class after the other."""
    out = lambda s: hashlib.md5(s.encode()).hexdigest()[0] in "012"
    grams = lambda s: [(U.START * U.ORDER + s + U.END)[i:i + U.ORDER + 1] for i in range(len(s) + 1)]
    letters = {g[-1] for s, _ in texts for g in grams(s)}

    def model(kind):
        n, follow = Counter(), {}
        for s, allowed in texts:
            if allowed is kind and not out(s):
                for g in grams(s):
                    for k in range(U.ORDER + 1):
                        n[g[U.ORDER - k:]] += 1
                        n["ctx", k, g[U.ORDER - k:-1]] += 1
                        follow.setdefault((k, g[U.ORDER - k:-1]), set()).add(g[-1])

        def p(g):
            value = 1 / len(letters)
            for k in range(U.ORDER + 1):
                c = g[U.ORDER - k:-1]
                t = len(follow.get((k, c), ()))
                if t:
                    value = (n[g[U.ORDER - k:]] + t * value) / (n["ctx", k, c] + t)
            return value
        return p

    a, b = model(True), model(False)
    return {s: sum(math.log(a(g)) - math.log(b(g)) for g in grams(s)) / (len(s) + 1) for s, _ in texts}


def test_scores_against_plain_python(spark):
    rng = random.Random(9)
    texts = {}
    for _ in range(120):
        s = rng.choice(["blog", "shop", "é"]) + str(rng.randrange(50)) + rng.choice([".org", ".com", ".net"]) + rng.choice(["/a", "/b/c", ""])
        texts[s] = rng.choice([True, False, None])
    df = spark.createDataFrame(list(texts.items()), "s string, allowed boolean").repartition(4)
    got = {r.s: r.score for r in U.text_scores(df).collect()}
    want = brute_scores(list(texts.items()))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_calibration_separates(spark):
    rows = [(f"x{i}", i % 2 == 0, (1.0 if i % 2 == 0 else -1.0) + 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, allowed boolean, score double")
    assert -0.7 < U.calibrate(df) <= 1.3
    assert U.calibrate(df.where("allowed")) == 0.0


def test_missing_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in U.filter_urls(df).collect()) == [(1, "allow"), (1, "allow"), (2, "block")]
    assert U.filter_urls(df.limit(0)).collect() == []


def test_query_matches_sql(spark):
    for sf in ("0.001", "0.01"):
        info = compare(spark, f"/root/testdata/sf{sf}", "op7", QUERIES["op7_url_filter"], ORACLE["op7_url_filter"])
        assert info["ok"], info

"""Decontamination against a direct search, the SQL twin and block-wise scans."""

import random

import lexeval.llm.decontam as D
from lexeval.llm.queries import ORACLE, QUERIES
from tests.llm.brute import alnum_words
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


def fixture():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["é", "x", "Y"]) + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 14, 40])))) for i in range(25)]
    items += [(25, None), (26, "?!"), (None, "only here, 1 2 3"), (3, items[3][1])]
    docs = [(0, None), (1, ""), (2, "..."), (None, "x Only HERE 1 2 3 y")]
    for i in range(60):
        w = [word() for _ in range(rng.randrange(400))]
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(t) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in t[max(0, a - 12):a + 12]]
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs + docs[10:14], items


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i:i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def result(df):
    from pyspark.sql import functions as F
    got = df.select("doc_id", "f.n_words", D.covered(F.col("f.spans")), F.sort_array("f.items")).collect()
    return sorted((tuple(r) for r in got), key=repr)


def frames(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(a, b, "keep") for a, b in docs], "doc_id long, text string, __found string").repartition(3)
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string")


def test_scan_against_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    docs, items, d, b = frames(spark)
    want = brute(docs, items)
    assert any(r[2] for r in want)
    assert result(D.scan(d, b, "f")) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 600)
    assert result(D.scan(d, b, "f")) == want


def test_removal_leaves_no_window_and_clean_documents_alone(spark):
    docs, items, d, b = frames(spark)
    hit = {x[0] for x in brute(docs, items) if x[2]}
    kept = D.drop_documents(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - hit
    rows = [(r.doc_id, r.text) for r in D.remove_spans(d, b).collect()]
    assert not any(r[2] for r in brute(rows, items))
    clean = [(x, t) for x, t in docs if x not in hit]
    assert sorted((r for r in rows if r[0] not in hit), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark):
    _, _, d, b = frames(spark)
    assert D.scan(d.limit(0), b, "f").collect() == []
    assert all(not r.f.spans for r in D.scan(d, b.limit(0), "f").collect())


def test_query_matches_sql(spark):
    info = compare(spark, SF, "op6", QUERIES["op6_decontamination"], ORACLE["op6_decontamination"])
    assert info["ok"], info

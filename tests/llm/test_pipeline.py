"""The pipeline, stage by stage, against brute force over what each was given."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from lexeval.llm.minhash import banding, keep_first
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_minhash import brute as groups
from tests.llm.test_packing import check, reference_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """Input and output rows of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6, None, None, None, 0), (10 ** 6 + 1, "", "en", "a", 0), (10 ** 6 + 2, "12 34 !", "en", "a", 7)], docs.schema)
    odd = odd.union(docs.where("doc_id in (3, 4)"))  # repeated rows
    docs, out = docs.union(odd), []
    for name, step in P.STAGES:
        got = step(spark, docs, SF)
        rows = got.collect()
        out.append((name, docs.columns, docs.collect(), got.columns, rows))
        docs = spark.createDataFrame(rows, got.schema)
    return {x[0]: x[1:] for x in out}


def test_stages_and_columns(staged):
    assert [n for n, _ in P.STAGES] == list(staged)
    assert all(after == before for before, _, after, _ in list(staged.values())[:-1])
    assert all(len(after) and len(after) < len(before) for _, before, _, after in list(staged.values())[:-1])


def test_language_rejects_only_texts_without_language(staged):
    _, before, _, after = staged["language"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2} <= gone and len(gone) <= 3 + 0.02 * len(before)


def test_line_dedup_leaves_each_line_once(staged):
    from tests.llm.test_linededup import norm
    _, before, _, after = staged["line_dedup"]
    seen = {}
    for r in after:
        assert r.n_chars == len(r.text)
        for line in r.text.split("\n"):
            if norm(line):
                assert seen.setdefault(norm(line), r.doc_id) == r.doc_id
    kept = {r.doc_id: r.text for r in after}
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            first.setdefault(norm(line), r.doc_id)
    unique = [r for r in before if all(first[norm(x)] == r.doc_id for x in r.text.split("\n"))]
    assert sum(kept.get(r.doc_id) == r.text for r in unique) > 0.6 * len(unique)  # the rest has similar or inner repeats


def test_near_dedup_against_brute_force(staged):
    _, before, _, after = staged["near_dedup"]
    rows = list({(r.doc_id, r.text) for r in before})
    want = sorted(d for d, _, c in groups(rows, 5, 80) if d == c)
    assert sorted(r.doc_id for r in after) == want


def test_decontamination_against_brute_force(staged, spark):
    _, before, _, after = staged["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = sorted(x[0] for x in leaks([(r.doc_id, r.text) for r in before], items) if not x[2])
    assert sorted(r.doc_id for r in after) == clean


def test_packing_round_trip(staged):
    _, before, _, after = staged["packing"]
    check(after, dict(zip([r.doc_id for r in before], reference_ids([r.text for r in before]))))


def test_run_equals_the_stages(staged, spark):
    got = P.run(spark, SF)
    assert got.columns == staged["packing"][2]
    assert got.count() > 0


def test_keep_first_with_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, None, "n"), (3, None, "n"), (4, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = keep_first(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0), (True, 0)]
    assert keep_first(df.limit(0)).collect() == []


def test_banding_follows_the_threshold():
    assert banding(85) == (28, 7) and banding(80) == (39, 5)

"""Lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexeval.llm import lexical as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(d, Counter(tokens(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n, length, df = len(bags), sum(c.total() for _, c in bags), Counter(t for _, c in bags for t in c)
    out = set()
    for item, text in items:
        scored = []
        for d, c in bags:
            m = 10 + (90 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(tokens(text)) if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out |= {(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])}
    return out


def fixture(n=600, seed=3):
    rng = random.Random(seed)
    zipf = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(30000)]
    docs = [(0, None), (1, ""), (2, "... !"), (None, "t1 t2 t3 t4"), (7, "Été T1 t1"), (7, "Été T1 t1")]
    docs += [(i, " ".join(rng.choice(zipf) for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(10, n)]
    docs += [(n + i, docs[20 + i % 3][1]) for i in range(30)]  # ties
    items = [(i, " ".join(rng.choice(zipf) for _ in range(rng.choice([1, 2, 10, 30])))) for i in range(25)]
    items += [(30, docs[20][1]), (31, "nothing known"), (32, ""), (33, None), (34, "été T1"), (34, "été T1"), (35, "T1 t1 t1 t2")]
    return docs, items


def run(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, score int, terms int").repartition(parts)
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    return [tuple(r) for r in S.ranked(d, i, **kw).select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("segment,postings,batch", [(8192, 2_000_000, 1 << 20), (64, 500, 300)])
def test_against_scoring_everything(spark, monkeypatch, segment, postings, batch):
    docs, items = fixture()
    monkeypatch.setattr(S, "BATCH_BYTES", batch)
    monkeypatch.setattr(S.batches, "__defaults__", (batch,))
    monkeypatch.setattr(S, "SEGMENT", segment)
    monkeypatch.setattr(S, "POSTINGS", postings)
    got = run(spark, docs, items)
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture(40)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, [(1, None), (2, "!")], items) == []


def test_very_long_text(spark):
    docs = [(1, "alpha beta " * 800_000 + "y" * 6_000_000 + " gamma"), (2, "alpha"), (3, "delta"), (4, "delta gamma")]
    items = [(1, "gamma alpha"), (2, "delta")]
    assert set(run(spark, docs, items)) == brute(docs, items)


def local_segment(seed=9, n=3000, terms=300, planted=None):
    rng = np.random.default_rng(seed)
    topic = rng.integers(0, 10, n)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 4), 30 + 27 * t + rng.integers(0, 27, 12)])) for t in topic]
    if planted is not None:  # a dozen documents hold all of an item
        for i in range(5, n, n // 12):
            rows[i] = np.union1d(rows[i], planted)
    start = np.cumsum([0, *map(len, rows)])
    term = np.concatenate(rows)
    impact = rng.integers(10 ** 6, 2 * 10 ** 6, len(term))
    return S.Segment(np.arange(n), np.ones(n, bool), start, term, impact, terms), topic


def test_summaries_are_the_maxima_of_their_blocks():
    segment, _ = local_segment()
    beside = {t: np.arange(0, 300, 2) for t in (3, 40, 100, 299)}
    seen = {t: [] for t in beside}
    for t, docs, coordinate, most in S.blocks(segment, beside):
        seen[t] += docs.tolist()
        want = {}
        for d in docs:
            for e in range(segment.start[d], segment.start[d + 1]):
                if segment.term[e] % 2 == 0:
                    want[int(segment.term[e])] = max(want.get(int(segment.term[e]), 0), int(segment.impact[e]))
        assert dict(zip(coordinate.tolist(), most.tolist())) == want
    for t, docs in seen.items():  # every document of a list lies in one block
        assert sorted(docs) == sorted(segment.posting(t)[0].tolist())


def test_blocks_hold_similar_documents():
    segment, _ = local_segment()
    docs, _ = segment.posting(3)
    own = S.cluster(S.sketches(segment)[docs])
    full = np.zeros((len(docs), 300))
    at, place = segment.entries(docs)
    full[at, segment.term[place]] = segment.impact[place]
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    alike = full @ full.T
    inside = own[:, None] == own[None, :]
    np.fill_diagonal(inside, False)
    assert alike[inside].mean() > 1.3 * alike[~inside].mean()


def test_blocks_are_skipped_and_nothing_is_lost():
    import pyarrow as pa
    weight = np.full(300, 10)
    item = np.unique(np.random.default_rng(1).integers(0, 300, 12))
    segment, _ = local_segment(planted=item)
    full = np.zeros(len(segment.ids), np.int64)
    for t in item:
        docs, impact = segment.posting(t)
        full[docs] += impact
    want = sorted(full.tolist(), reverse=True)[:10]
    held = {"ids": segment.ids, "start": segment.start, "term": segment.term, "impact": segment.impact}
    rows = list(S.blocks(segment, {int(t): item for t in item}))
    cat = lambda i: np.concatenate([r[i] for r in rows])
    held |= {"block_term": np.array([r[0] for r in rows]), "block_docs": cat(1), "sum_term": cat(2), "sum_most": cat(3),
             "block_at": np.cumsum([0, *[len(r[1]) for r in rows]]), "sum_at": np.cumsum([0, *[len(r[2]) for r in rows]])}
    index = S.Index({k: pa.array([v], pa.list_(pa.int64()))[0] for k, v in held.items()}, 300)
    for floor in (1, want[-1]):
        seen = np.zeros(5, np.int64)
        score, _ = index.search(item, weight, floor, 10, seen)
        assert score.tolist() == want
    assert seen[1] > 0 or seen[3] > 0  # with the true threshold, lists or blocks were left out
    assert seen[4] < (full > 0).sum() * 0.7

"""Source divergence against a plain-Python version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexeval.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "text string, lang string, source string, value int, rank int, cells string"


def brute(docs, least, top):
    out = []
    docs = [((t or "").translate(LOWER), la or "", s or "") for t, la, s in docs]
    for lang in sorted({d[1] for d in docs}):
        df, count = Counter(), {}
        for text, la, source in docs:
            if la == lang:
                words = TERM.findall(text)
                df.update(set(words))
                count.setdefault(source, Counter()).update(words)
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        whole = share(sum(count.values(), Counter()))
        p = {s: share(c) for s, c in count.items()}
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(whole[t] - p[s][t], t) for t in kept if count[s][t] and p[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (r[0], r[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(rows[:most])]
    return sorted(out)


def run(spark, docs, least, top, **kw):
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in D.divergence(df, least, top, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def fixture():
    rng = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "don't", "ß", "日本", "tie", "same"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(None, None, None), ("", "", ""), (None, "en", "empty"), ("12 34 !", "en", "empty"), ("lonely", "de", "one"), ("lonely", "de", "one")]
    for i in range(150):
        source = "hot" if rng.random() < 0.5 else f"s{rng.randrange(4)}"
        docs.append((" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "fr", None]), source))
    return docs


@pytest.mark.parametrize("least,top,limit", [(3, 4, 1 << 20), (1, 50, 20), (10 ** 6, 5, 100)])
def test_against_brute_force(spark, least, top, limit):
    assert run(spark, fixture(), least, top, limit=limit) == brute(fixture(), least, top)


def test_blocks_of_sources(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(" ".join(rng.choice("abcdefg") for _ in range(9)), "en", f"s{i:03d}") for i in range(300)]  # more sources than a block holds
    assert run(spark, docs, 2, 3) == brute(docs, 2, 3)


def test_empty_table_and_very_long_text(spark):
    assert run(spark, [], 1, 5) == []
    text = "ab " * 2_000_000 + "é" * 5_000_000 + " ab"
    got = run(spark, [(text, "en", "a"), ("ab", "en", "b")], 1, 5)
    assert got == brute([(text, "en", "a"), ("ab", "en", "b")], 1, 5)


def test_shares_do_not_overflow():
    count, total, v = np.array([3 * 10 ** 12, 0, 7]), np.array([8 * 10 ** 12] * 3), 10 ** 6
    assert D.shares(count, total, v).tolist() == [1 + 10 ** 9 * (int(c) + 5) // (8 * 10 ** 12 + 5 * v) for c in count]

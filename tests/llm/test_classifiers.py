"""Language ID and toxicity: held-out accuracy and defined edge cases."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa

from lexeval.llm import langid, toxicity
from lexeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out_accuracy(spark):
    rows = QUERIES["op8_language"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, la, "x") for i, (t, la) in enumerate([
        ("der die das und nicht ein eine", "de"), ("the and of to in that with", "en"), ("ein und das nicht", "de"),
        ("that is the one and of", "en"), ("no label here", None), (None, "en"), ("123 !!", "de"), ("", "en")] * 4)],
        "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    out = docs.select("text", langid.predictor(model)(docs["text"]).alias("p")).collect()
    for r in out:
        if r.text in (None, "", "123 !!"):
            assert (r.p.lang, r.p.score) == ("und", 0.0)
        else:
            assert r.p.lang in ("de", "en") and 0 < r.p.score <= 1
    nothing = langid.fit(docs.limit(0))
    assert {tuple(r.p) for r in docs.select(langid.predictor(nothing)(docs["text"]).alias("p")).collect()} == {("und", 0.0)}
    one = langid.fit(docs.where("lang = 'de'"))
    assert one.predict("hello") == ("de", 1.0)
    long = "the and of " * 400_000
    assert model.predict(long)[0] == "en"


def test_language_sample_gives_each_language_its_share(spark):
    n, rare = 1500, 200
    rows = [(f"text {i} of {la}", f"l{la}") for la in range(12) for i in range(n)] + [(f"rare text {i}", "rare") for i in range(rare)]
    rows += [("copied text", "l0")] * 5000 + [(None, "l1"), ("no label", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    langs, sample = langid.sampled(df)
    got = sample.collect()
    assert len(got) == langid.SAMPLE == len({(r.lang, r.text) for r in got}) and langs == sorted({r[1] for r in rows if r[1]})
    count = {la: sum(r.lang == la for r in got) for la in langs}
    share = (langid.SAMPLE - rare) / 12
    assert count.pop("rare") == rare and all(abs(c - share) < 1 for c in count.values())
    assert langid.shares({"a": 5, "b": 100, "c": 30}, 60) == {"a": 5, "b": 28, "c": 27}


def test_every_language_is_learned_also_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 30)
    names = [f"l{i}" for i in range(50)]  # equal counts: a tie of all
    rows = [(f"{chr(0x400 + i) * 4} {chr(0x400 + i) * (j + 1)}", la) for i, la in enumerate(names) for j in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    langs, sample = langid.sampled(df)
    assert langs == sorted(names) and sorted(r.lang for r in sample.collect()) == langs
    model = langid.fit(df)
    assert model.langs == langs and model.weights.shape == (langid.DIMS, 50) and len(model.bias) == 50


def test_ftrl_step_by_step():
    """The same fit in plain Python, one weight at a time."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(7, 3, replace=False)), rng.random(3)) for _ in range(12)]
    y = rng.integers(0, 3, 12)
    z = {(c, k): 0.0 for c in [*range(7), "b"] for k in range(3)}
    n = dict.fromkeys(z, 0.0)

    def weight(c, k):
        l1 = 0.0 if c == "b" else langid.L1
        if abs(z[c, k]) <= l1:
            return 0.0
        return -(z[c, k] - math.copysign(l1, z[c, k])) / ((langid.BETA + math.sqrt(n[c, k])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(rows)):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), ("b", 1.0)]
            score = [sum(v * weight(c, k) for c, v in x) for k in range(3)]
            total = sum(math.exp(s) for s in score)
            for k in range(3):
                g = math.exp(score[k]) / total - (y[i] == k)
                for c, v in x:
                    w, old = weight(c, k), n[c, k]
                    n[c, k] = old + (v * g) ** 2
                    z[c, k] += v * g - (math.sqrt(n[c, k]) - math.sqrt(old)) / langid.ALPHA * w
    w, b = langid.fit_ftrl(rows, y, 3, 7)
    assert np.allclose(w, [[weight(c, k) for k in range(3)] for c in range(7)], atol=1e-12)
    assert np.allclose(b, [weight("b", k) for k in range(3)], atol=1e-12) and np.count_nonzero(w)


def test_toxicity_held_out_accuracy(spark):
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    pos = [r.score for r in held if truth[r.doc_id] == 1]
    neg = [r.score for r in held if truth[r.doc_id] == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.95, auc
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = [r for r in rows if r.n_offending]
    assert found and all(r.predicted == 1 and r.n_offending == len(r.offending.split("\n")) for r in found)
    assert all(s in text[r.doc_id] for r in found for s in r.offending.split("\n"))
    assert len(found) > 0.5 * sum(r.predicted for r in rows)


def test_toxicity_locates_sentences_and_edge_cases(spark):
    bad = "All is calm. You are a vile gronk! Then more words follow here."
    good = "All is calm. You are a kind friend! Then more words follow here."
    n = 60
    docs = spark.createDataFrame([(i, (bad if i % 2 else good) + f" Line {i}.", 0.5) for i in range(n)]
                                 + [(n, None, 0.1), (n + 1, "", 0.1), (n + 2, "...", 0.1), (None, bad, 0.1)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)] + [(1, None), (None, 1), (1, 0), (n, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = docs.select("text", toxicity.scorer(model)(docs["text"]).alias("s"),
                      toxicity.offending(model)(docs["text"]).alias("o")).collect()
    for r in out:
        if not r.text or r.text == "...":
            assert r.s == 0 and r.o == []
        elif "gronk" in r.text:
            assert r.s >= 0.5 and [x.sentence for x in r.o] == ["You are a vile gronk"]
        else:
            assert r.s < 0.5 and r.o == []
    silent = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.s for r in docs.select(toxicity.scorer(silent)(docs["text"]).alias("s")).collect()} == {0.0}


def test_toxicity_scores_are_the_noisy_or_of_sentences_found_one_by_one():
    """Sentences, features and noisy-or in plain Python; repeated rows, ties, a very long text."""
    rng = np.random.default_rng(5)
    w = np.where(rng.random(toxicity.DIMS) < 0.3, rng.normal(0, 2, toxicity.DIMS), 0).astype(np.float32)
    model = toxicity.Model(w, -2.0)
    texts = ["One bad word. Another, fine one! ok\nlast line", "", None, "...", "Same words same words? Same words.",
             "é à la carte. ÜBER alles", "One bad word. Another, fine one! ok\nlast line", "long sentence here. " * 50_000]
    got, found = model.judge(pa.array(texts), 0.5)

    def score(sentence):  # features of a sentence do not depend on its neighbours
        features, *_ = toxicity.sentences(pa.array([sentence]))
        return 1 / (1 + math.exp(-(sum(float(w[f & (toxicity.DIMS - 1)]) for f in features) - 2.0)))

    for text, p, own in zip(texts, got, found):
        cut = [s for s in re.split(r"[.!?\n]", text or "") if re.search(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", s)]
        seen = {s: score(s) for s in set(cut)}
        assert math.isclose(p, 1 - math.prod(1 - seen[s] for s in cut), abs_tol=1e-9)
        assert [x["sentence"] for x in own] == [s.strip(" ,") for s in cut if seen[s] >= 0.5]
    assert got[0] == got[6]


def test_toxicity_training_step_by_step():
    """Noisy-or gradients by finite differences, AdaGrad with soft thresholds, in plain Python."""
    docs = ["aa bb. cc dd", "aa cc! bb", "dd ee. aa", "ee. cc", "bb ee? dd", "aa. bb. cc. dd. ee"] * 2
    y = [1, 0, 1, 0, 0, 1] * 2
    out = next(toxicity._train([pa.RecordBatch.from_arrays([pa.array(docs), pa.array(y)], names=["text", "toxic"])]))
    got = dict(zip(*(c.to_pylist() for c in out.columns)))
    col = lambda word: int(toxicity.sentences(pa.array([word]))[0][0]) & (toxicity.DIMS - 1)
    bags = [[sorted({col(x) for x in re.findall("[a-z]+", s)}) for s in re.split("[.!?]", d)] for d in docs]
    w, g2, b, gb2 = {}, {}, toxicity.BIAS, 1.0
    order = np.random.default_rng(11)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(docs)):
            z = [sum(w.get(c, 0.0) for c in bag) + b for bag in bags[i]]

            def loss(z, label=y[i]):
                none = math.prod(1 / (1 + math.exp(v)) for v in z)
                return -math.log(1 - none) if label else -math.log(none)
            g = [(loss([*z[:k], z[k] + 1e-4, *z[k + 1:]]) - loss([*z[:k], z[k] - 1e-4, *z[k + 1:]])) / 2e-4 for k in range(len(z))]
            for c in {c for bag in bags[i] for c in bag}:
                grad = sum(x for x, bag in zip(g, bags[i]) if c in bag)
                g2[c] = g2.get(c, 1e-2) + grad ** 2
                rate = toxicity.RATE / math.sqrt(g2[c])
                new = w.get(c, 0.0) - rate * grad
                w[c] = math.copysign(max(abs(new) - rate * toxicity.L1, 0), new)
            gb2 += sum(g) ** 2
            b -= toxicity.RATE / math.sqrt(gb2) * sum(g)
    assert math.isclose(got.pop(-1), b, rel_tol=1e-4)
    want = {c: v for c, v in w.items() if v}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c], rel_tol=1e-3, abs_tol=1e-4) for c in want)


def test_toxicity_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, toxic string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int, text string"))
    assert model.weights is None and docs.select(toxicity.judge(model)(docs["text"]).alias("j")).collect() == []

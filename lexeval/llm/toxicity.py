"""Toxicity by multiple-instance learning: only documents are labelled, the
model scores sentences, and a document's score is the noisy-or of them,
1 - prod(1 - p).  Trained on document labels, it then points to the sentences.

A sentence ends at ``.``, ``!``, ``?`` or a line feed.  Words are runs of ASCII
letters and digits and non-ASCII characters, A-Z lower-cased; a sentence has
its distinct words and word beginnings (``PREFIXES`` bytes, for inflected
forms), hashed to ``DIMS`` columns, as features of a logistic model.  It is
fitted by AdaGrad with an l1 penalty on a bounded sample of labelled documents
(``POSITIVES`` and ``NEGATIVES`` at most, about, picked by a hash).  Scores
cover whole texts.  A document may be toxic by many weak sentences, none of
which offends by itself.

Defined cases.  A null or empty text has no sentence and scores 0.  Ids with
several labels count as toxic if one says so; null labels and ids are not
learned from.  Without a label of each kind every score is 0.  Repeated rows
get equal scores.  Only the columns passed in are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeval.llm.words import ALNUM, text_buffer, words

DIMS = 1 << 20
POSITIVES, NEGATIVES = 3000, 6000
EPOCHS = 8
RATE, L1, BIAS = 0.3, 8e-3, -6.0
PREFIXES = (4, 5, 6)
#: Words that fewer sample documents hold get no weight.
LEAST_DOCS = 4

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(column):
    """(features, sentence of each word, word bounds of the rows, starts, ends)
    of a string column.  Sentences are numbered through the whole column;
    ``features`` are distinct ``sentence << 20 | column`` values in order."""
    hashes, bounds, starts, ends, *heads = words(column, ALNUM, spans=True, prefixes=PREFIXES)
    data, _ = text_buffer(column)
    own = np.searchsorted(np.flatnonzero(_ENDS[data]), starts)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sentence = np.cumsum(np.concatenate([[0], (np.diff(own) > 0) | (np.diff(row) > 0)])) if len(own) else own
    at = np.concatenate([sentence << 20 | (h >> np.uint64(44)).astype(np.int64) for h in (hashes, *heads)])
    at = at[np.concatenate([h != 0 for h in (hashes, *heads)])]
    return np.unique(at), sentence, bounds, starts, ends


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _train(batches):
    docs, labels = [], []
    for batch in batches:
        features, sentence, bounds, _, _ = sentences(batch.column(0))
        for i, label in enumerate(batch.column(1).to_pylist()):
            lo, hi = bounds[i], bounds[i + 1]
            if hi > lo:
                s0, s1 = sentence[lo], sentence[hi - 1] + 1
                own = features[np.searchsorted(features, s0 << 20):np.searchsorted(features, s1 << 20)]
                docs.append((own & (DIMS - 1), (own >> 20) - s0, int(s1 - s0)))
                labels.append(label)
    seen = np.zeros(DIMS, np.int64)
    for at, _, _ in docs:
        seen[np.unique(at)] += 1
    kept = []
    for at, s, n in docs:
        often = seen[at] >= LEAST_DOCS
        kept.append((at[often], s[often], n, *np.unique(at[often], return_inverse=True)))
    w, g2, b, gb2 = np.zeros(DIMS), np.full(DIMS, 1e-2), BIAS, 1.0
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(kept)):
            at, s, n, cols, inverse = kept[i]
            p = np.clip(_sigmoid(np.bincount(s, weights=w[at], minlength=n) + b), 1e-9, 1 - 1e-9)
            none = np.exp(np.log1p(-p).sum())
            g = p if labels[i] == 0 else -p * none / max(1 - none, 1e-9)
            if len(cols):
                grad = np.bincount(inverse, weights=g[s], minlength=len(cols))
                g2[cols] += grad ** 2
                rate = RATE / np.sqrt(g2[cols])
                new = w[cols] - rate * grad
                w[cols] = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
            total = g.sum()
            gb2 += total ** 2
            b -= RATE / np.sqrt(gb2) * total
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], b))], names=["at", "w"])


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def sentence_scores(self, column):
        features, sentence, bounds, starts, ends = sentences(column)
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        z = np.bincount(features >> 20, weights=self.weights[features & (DIMS - 1)], minlength=n) + self.bias
        return _sigmoid(z), sentence, bounds, starts, ends

    def judge(self, column, least: float) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of the rows and, for each, its sentences that score ``least``
        or more, in order."""
        rows = len(column)
        out, found = np.zeros(rows), [[] for _ in range(rows)]
        if self.weights is None:
            return out, found
        p, sentence, bounds, starts, ends = self.sentence_scores(column)
        clean = np.log1p(-np.minimum(p, 1 - 1e-12))
        for i in range(rows):
            lo, hi = bounds[i], bounds[i + 1]
            if hi > lo:
                out[i] = -np.expm1(clean[sentence[lo]:sentence[hi - 1] + 1].sum())  # alike for equal rows
        data, _ = text_buffer(column)
        for s in np.flatnonzero(p >= least):
            lo, hi = np.searchsorted(sentence, s), np.searchsorted(sentence, s, side="right")
            row = int(np.searchsorted(bounds, lo, side="right")) - 1
            found[row].append({"sentence": data[starts[lo]:ends[hi - 1]].tobytes().decode(), "score": float(p[s])})
        return np.clip(out, 0, 1), found


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = known.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(None, 0.0)
    part = {0: min(1.0, NEGATIVES / n[0]), 1: min(1.0, POSITIVES / n[1])}
    bound = F.when(F.col("toxic") == 1, F.lit(int(part[1] * (1 << 30)))).otherwise(F.lit(int(part[0] * (1 << 30))))
    # at most about POSITIVES + NEGATIVES ids of 12 bytes
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound).limit(POSITIVES + NEGATIVES + 1000)
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where("text is not null").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"]))
    sample = texts.orderBy(F.xxhash64("doc_id", "text")).limit(POSITIVES + NEGATIVES + 1000).select("text", "toxic")
    rows = sample.coalesce(1).mapInArrow(_train, "at long, w double").collect()  # DIMS + 1 rows at most
    if not rows:
        return Model(None, 0.0)
    weights, bias = np.zeros(DIMS), 0.0
    for at, w in rows:
        if at < 0:
            bias = w
        else:
            weights[at] = w
    return Model(weights.astype(np.float32), bias)


def judge(model: Model, least: float = 0.5):
    """Column function: text -> struct(score, offending), the document's score
    and the sentences that score ``least`` or more, from their first word to
    their last, each with its score."""
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("struct<score:double,offending:array<struct<sentence:string,score:double>>>")
    def run(text: pa.Array) -> pa.Array:
        scores, found = model.judge(text, least)
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(found, kind)], names=["score", "offending"])
    return lambda text: run(text.cast("string"))


def scorer(model: Model):
    """Column function: text -> document score."""
    return lambda text: judge(model)(text)["score"]


def offending(model: Model, least: float = 0.5):
    """Column function: text -> the offending sentences (see ``judge``)."""
    return lambda text: judge(model, least)(text)["offending"]

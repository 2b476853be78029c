"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal)
under an elastic-net penalty, then temperature calibration.

Features.  Lower-cased code points; what is not a letter counts as a space.
N-grams of 1 to 3 are hashed to ``DIMS`` columns, weighted by
(1 + ln count) * idf and scaled to unit length.  Document frequencies are
counted over all learning rows.  The classifier is fitted on a bounded sample
of their distinct (lang, text): at most ``SAMPLE``, the same number for each
language where it has as many; what a rare language leaves is dealt to the
others.  Every language has a text at least, also if there are more than
``SAMPLE`` of them.  Each language's are those of the smallest text hashes.  A
fifth of the sample is kept aside to fit the temperature.  What grows with the
languages alone: the trainer holds 16 bytes a language and column that occurs in
the sample, the model 4 bytes a language and column; its weights reach the
driver as one packed row a language.

Defined cases.  A null text or one without a letter is ``und`` with score 0.
Rows with a null language are not learned from.  With no learning row every
text is ``und`` with score 0; with one language every text with a letter gets
it.  Whole texts are read.  Repeated rows get equal results.  Only the columns
passed in are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 1 << 15
#: Bound on the rows that the classifier is fitted on.
SAMPLE = 6000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(columns, counts) of a text's hashed n-grams; empty without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[code]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate([[32], np.where(is_letter, code, 32), [32]]).astype(np.uint32)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    total = np.zeros(DIMS, np.int64)
    for lo in range(0, len(c), 1 << 20):  # a long text in pieces that overlap by two characters
        p = c[lo:lo + (1 << 20) + 2]
        last = lo + (1 << 20) >= len(c)
        one = (p + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:] * np.uint32(3)
        three = two[:-1] * np.uint32(0xC2B2AE35) + one[2:] * np.uint32(5)
        n = len(p) if last else 1 << 20
        for h in (one[:n], two[:n], three[:n]):
            h = h ^ (h >> np.uint32(15))
            total += np.bincount(((h * np.uint32(0x2C1B3C6D)) >> shift).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


def _frequencies(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            at, _ = grams(text or "")
            df[at] += 1
            n += 1
    at = np.flatnonzero(df)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["gram", "df"])


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = grams(text)
    value = (1 + np.log(count)) * idf[at]
    norm = np.sqrt((value ** 2).sum())
    return at, value / norm if norm else value


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dims: int = DIMS):
    """Weights (dims, classes) and bias of FTRL-proximal with elastic net.  The
    bias takes part without the l1 penalty."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(z, n, w, g):
        grown = np.sqrt(n + g * g)
        z += g - (grown - np.sqrt(n)) / ALPHA * w
        n += g * g

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            zi, ni = z[at], n[at]
            w, wb = weights(zi, ni, L1), weights(zb, nb, 0.0)
            g = _softmax(value @ w + wb)
            g[y[i]] -= 1
            step(zi, ni, w, value[:, None] * g)
            z[at], n[at] = zi, ni
            step(zb, nb, wb, g)
    return weights(z, n, L1), weights(zb, nb, 0.0)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its log."""
    if not len(y):
        return 1.0

    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """Languages, idf, weights, bias and temperature."""

    def __init__(self, langs, idf, weights, bias, temperature):
        self.langs, self.idf, self.bias, self.temperature = list(langs), idf, bias, temperature
        self.weights = weights  # (DIMS, languages), float32

    def predict(self, text: str | None) -> tuple[str, float]:
        at, value = _vector(text, self.idf) if text else (np.zeros(0, np.int64), None)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax((value @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _trainer(langs: list[str], idf: np.ndarray):
    """One task over the bounded sample; the model leaves as one row a language:
    its bias, the columns of its weights and the weights, packed."""
    def run(batches):
        code = {x: i for i, x in enumerate(langs)}
        rows, y, aside = [], [], []
        for batch in batches:
            for text, lang, fold in zip(*(c.to_pylist() for c in batch.columns)):
                v = _vector(text, idf)
                if len(v[0]):
                    rows.append(v)
                    y.append(code[lang])
                    aside.append(fold == 0)
        y, aside = np.array(y, int), np.array(aside, bool)
        if len(y) < 50:  # too few to keep any aside
            aside[:] = False
        used = np.unique(np.concatenate([at for at, _ in rows])) if rows else np.zeros(0, np.int64)
        rows = [(np.searchsorted(used, at), v) for at, v in rows]
        w, b = fit_ftrl([r for r, a in zip(rows, aside) if not a], y[~aside], len(langs), len(used))
        held = [(v @ w[at] + b) for (at, v), a in zip(rows, aside) if a]
        t = fit_temperature(np.array(held), y[aside]) if held else 1.0
        for k in range(len(langs)):
            at = np.flatnonzero(w[:, k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([b[k]]), pa.array([t]), pa.array([used[at].astype("<i4").tobytes()], pa.binary()),
                 pa.array([w[at, k].astype("<f4").tobytes()], pa.binary())], names=["k", "bias", "temperature", "at", "w"])
    return run


def shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows of each language: equal shares of ``total``, at most its count; what
    is left over goes to the languages that have more."""
    out = {}
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, total // (len(counts) - i))
        total -= out[lang]
    return out


def sampled(labelled: DataFrame) -> tuple[list[str], DataFrame | None]:
    """The languages to learn, those with the most distinct texts, and the
    sample (text, lang, fold) of ``labelled(text, lang)``."""
    rows = labelled.where("text is not null and lang is not null")
    pick = F.shiftrightunsigned(F.xxhash64("text"), 1)
    found = rows.select("lang", pick.alias("pick")).distinct().groupBy("lang").count().collect()  # a row a language
    if not found:
        return [], None
    counts = {r["lang"]: r["count"] for r in found}
    # wide enough that each language has its share below the bound; the rest goes by rank
    wide = [(x, n, int(min(1.0, (n + 8 * n ** 0.5 + 64) / counts[x]) * ((1 << 63) - 1024)))
            for x, n in shares(counts, max(SAMPLE, len(counts))).items()]
    bounds = rows.sparkSession.createDataFrame(wide, "lang string, most long, below long")
    near = (rows.select("lang", "text", pick.alias("pick")).join(F.broadcast(bounds), "lang")  # as small as ``found``
            .where((F.col("pick") <= F.col("below")) | (F.col("below") >= (1 << 63) - 1024)).distinct())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= F.col("most"))
    return sorted(counts), sample.orderBy("pick", "lang", "text").select("text", "lang", F.pmod(F.xxhash64("lang", "text"), F.lit(5)).alias("fold"))


def fit(labelled: DataFrame) -> Model:
    """Model from ``labelled(text, lang)``; rows with a null lang are left out."""
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "lang is not null")
    df = labelled.select("text").mapInArrow(_frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    counts = {r.gram: r.df for r in df.collect()}  # DIMS + 1 rows at most
    total = counts.pop(-1, 0)
    idf = np.full(DIMS, np.log(1.0 + total) + 1)
    for g, d in counts.items():
        idf[g] = np.log((1 + total) / (1 + d)) + 1
    langs, sample = sampled(labelled)
    if not langs:
        return Model([], idf, np.zeros((DIMS, 0), np.float32), np.zeros(0), 1.0)
    rows = sample.coalesce(1).mapInArrow(_trainer(langs, idf), "k long, bias double, temperature double, at binary, w binary").collect()
    weights, bias = np.zeros((DIMS, len(langs)), np.float32), np.zeros(len(langs))
    for r in rows:
        weights[np.frombuffer(r.at, "<i4"), r.k] = np.frombuffer(r.w, "<f4")
        bias[r.k] = r.bias
    return Model(langs, idf, weights, bias, rows[0].temperature if rows else 1.0)


def predictor(model: Model):
    """Column function: text -> struct(lang, score)."""
    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        out = [model.predict(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()),
                                           pa.array([x[1] for x in out], pa.float64())], names=["lang", "score"])
    return lambda text: predict(text.cast("string"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod ``folds`` is ``fold``; a null id is
    not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))

"""Multi-reference n-gram metrics as DataFrame aggregations: corpus BLEU,
lower-cased BLEU and chrF++.

Input of every metric: a DataFrame of aligned rows
``(<keys>..., example_id, prediction string, references array<string>)``
(``keys`` is usually ``["step"]`` or ``["run", "step"]``).  One job scores
every group at once; the output has one row per group.

Plan shape.  All n-gram work is local to one aligned row (a prediction and
its references), so it runs as a narrow stage right after the alignment join:
JVM regex tokenisation, then an Arrow-batched counting kernel, then a partial
aggregation of a few integers per example.  The only exchange after the join
carries those partial sums (one row per group and task).

Definitions follow the public papers / reference implementations
(Papineni et al. 2002 with "exp" smoothing and the 13a tokenizer; Popović
2015/2017 chrF with word n-grams): see the docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexeval.functions.text import chrf_chars, chrf_words, tok_13a
from lexeval.operators import kernels
from lexeval.operators.sizing import spread


def usable_refs(col: str | Column = "references") -> Column:
    """References that take part in scoring, in every metric: NULL and empty
    strings are dropped, so padding a ragged list with "" changes nothing.  An
    example that has none left gets NULL scores and counts in no corpus score."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.coalesce(c, F.array().cast("array<string>")),
                    lambda r: r.isNotNull() & (r != ""))


def predicted() -> Column:
    """The prediction as every metric reads it: NULL counts as the empty text."""
    return F.coalesce(F.col("prediction"), F.lit(""))


def by_example(pairs: DataFrame, partitioned: bool = True) -> DataFrame:
    """Per-example work needs no co-location beyond the row itself (prediction
    and references are already aligned in one row), so rows are scored where
    they are — unless there are fewer partitions than task slots, in which case
    they are spread on ``example_id`` (see ``sizing.spread``).
    ``partitioned=False`` always hash-partitions on ``example_id``."""
    return spread(pairs, "example_id") if partitioned else pairs.repartition("example_id")


# ------------------------------------------------------------------ BLEU
def bleu_stats(pairs: DataFrame, keys: list[str], lowercase: bool = False, max_order: int = 4,
               partitioned: bool = True) -> DataFrame:
    """Per example: ``hyp_len``, ``ref_len`` (closest reference length, ties →
    shorter), ``match_n`` (hypothesis n-gram counts clipped by the maximum count
    in any one reference) and ``total_n`` for n = 1..max_order.

    Tokenisation is JVM regex; the multiset clipping is an Arrow-batched
    kernel over the two token arrays of the row (no explode, no shuffle)."""
    hyp = tok_13a(predicted(), lowercase)
    refs = F.transform(usable_refs(), lambda r: tok_13a(r, lowercase))
    base = by_example(pairs, partitioned).select(*keys, "example_id", hyp.alias("hyp"), refs.alias("refs"))
    st = base.select(*keys, "example_id", F.when(F.size("refs") > 0, kernels.bleu_stats_udf("hyp", "refs")).alias("s"))
    return st.select(*keys, "example_id", F.col("s.hyp_len").alias("hyp_len"), F.col("s.ref_len").alias("ref_len"),
                     *[F.col("s.matches")[n - 1].alias(f"match_{n}") for n in range(1, max_order + 1)],
                     *[over(F.col("s.hyp_len"), n - 1).alias(f"total_{n}")
                       for n in range(1, max_order + 1)])


def over(length: Column, less: int) -> Column:
    """``length - less``, at least 0; NULL stays NULL (``greatest`` skips it)."""
    return F.when(length > less, length - less).when(length.isNotNull(), F.lit(0))


def bleu_from_sums(sys_len: Column, ref_len: Column, matches: list[Column], totals: list[Column]) -> Column:
    """Corpus BLEU (0-100) from summed statistics, "exp" smoothing: the k-th
    order with zero matches gets precision 100 / (2^k · total); an order with no
    n-grams at all, or no match at any order, gives 0; no statistics give NULL."""
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(0.0)
    log_sum = F.lit(0.0)
    zeros = F.lit(0)
    any_zero_total = F.lit(False)
    for m, t in zip(matches, totals):
        zeros = zeros + F.when(m == 0, 1).otherwise(0)
        p = F.when(m > 0, 100.0 * m / t).otherwise(100.0 / (F.pow(F.lit(2.0), zeros) * t))
        any_zero_total = any_zero_total | (t == 0)
        log_sum = log_sum + F.log(F.when(t > 0, p).otherwise(F.lit(1.0)))
    any_match = F.lit(False)
    for m in matches:
        any_match = any_match | (m > 0)
    score = bp * F.exp(log_sum / len(matches))
    return F.when(sys_len.isNotNull(), F.when(~any_match | any_zero_total, F.lit(0.0)).otherwise(score))


def corpus_bleu(pairs: DataFrame, keys: list[str], lowercase: bool = False, name: str = "bleu",
                max_order: int = 4, partitioned: bool = True) -> DataFrame:
    """Corpus BLEU per group (``keys``), multi-reference."""
    st = bleu_stats(pairs, keys, lowercase, max_order, partitioned)
    sums = st.groupBy(*keys).agg(
        F.sum("hyp_len").alias("sys_len"), F.sum("ref_len").alias("ref_len"),
        *[F.sum(f"match_{n}").alias(f"m{n}") for n in range(1, max_order + 1)],
        *[F.sum(f"total_{n}").alias(f"t{n}") for n in range(1, max_order + 1)])
    return sums.select(*keys, bleu_from_sums(
        F.col("sys_len"), F.col("ref_len"),
        [F.col(f"m{n}") for n in range(1, max_order + 1)],
        [F.col(f"t{n}") for n in range(1, max_order + 1)]).alias(name))


# ------------------------------------------------------------------ chrF++
CHAR_ORDER = 6
WORD_ORDER = 2
BETA = 2.0


def _f_score(stats: Column, n_orders: int, beta: float = BETA) -> Column:
    """chrF from an ``array<struct<h,r,m>>`` of per-order counts: average P and R
    over orders where both sides have n-grams, then F-beta, ×100."""
    once = lambda value, body: F.transform(F.array(value), body)[0]
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("p"), F.lit(0.0).alias("r"))
    sums = F.aggregate(stats, zero, lambda a, s: F.when((s["h"] > 0) & (s["r"] > 0), F.struct(
        (a["n"] + 1).alias("n"), (a["p"] + s["m"] / s["h"]).alias("p"), (a["r"] + s["m"] / s["r"]).alias("r"))).otherwise(a))
    f2 = beta * beta
    mean = once(sums, lambda x: F.when(x["n"] > 0, F.struct((x["p"] / x["n"]).alias("p"), (x["r"] / x["n"]).alias("r"))).otherwise(
        F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("r"))))
    return once(mean, lambda x: F.when(x["p"] + x["r"] > 0, 100.0 * (1 + f2) * x["p"] * x["r"] / (f2 * x["p"] + x["r"])).otherwise(0.0))


def order_stats(flat: Column, orders: int) -> Column:
    """The kernel's flat ``[h, r, m] * orders`` as ``array<struct<o,h,r,m>>``."""
    return F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda o: F.struct(
        (o + 1).alias("o"), flat[o * 3].alias("h"), flat[o * 3 + 1].alias("r"), flat[o * 3 + 2].alias("m")))


def best_chrf(per_ref: Column, orders: int, beta: float = BETA) -> Column:
    """``struct<k,stats,f>`` of the reference with the highest sentence chrF,
    the first on ties; NULL without references."""
    scored = F.transform(F.transform(per_ref, lambda flat: order_stats(flat, orders)), lambda stats, k: F.struct(
        k.alias("k"), stats.alias("stats"), _f_score(stats, orders, beta).alias("f")))
    return F.get(F.array_sort(scored, lambda a, b: F.when(a["f"] > b["f"], -1).when(a["f"] < b["f"], 1)
                              .otherwise(a["k"] - b["k"])), F.lit(0))


def chrf_from_sums(h: list[Column], r: list[Column], m: list[Column], beta: float = BETA) -> Column:
    """Corpus chrF from the summed statistics of every order; NULL without any."""
    stats = F.array(*[F.struct(F.lit(o + 1).alias("o"), a.alias("h"), b.alias("r"), c.alias("m"))
                      for o, (a, b, c) in enumerate(zip(h, r, m))])
    return F.when(h[0].isNotNull(), _f_score(stats, len(h), beta))


def chrf_stats(pairs: DataFrame, keys: list[str], char_order: int = CHAR_ORDER, word_order: int = WORD_ORDER,
               beta: float = BETA, partitioned: bool = True) -> DataFrame:
    """Per example: statistics of the best reference (highest sentence chrF,
    first on ties) as ``stats array<struct<o,h,r,m>>`` plus ``chrf`` (sentence).

    Character/word splitting is JVM; per-reference counting and clipping is an
    Arrow-batched kernel; choosing the best reference is a higher-order
    expression over the few references of the row."""
    orders = char_order + word_order
    refs = usable_refs()
    base = by_example(pairs, partitioned).select(
        *keys, "example_id",
        chrf_chars(predicted()).alias("hc"), chrf_words(predicted()).alias("hw"),
        F.transform(refs, lambda r: chrf_chars(r)).alias("rc"),
        F.transform(refs, lambda r: chrf_words(r)).alias("rw"))
    st = base.select(*keys, "example_id", kernels.chrf_stats_udf(char_order, word_order)("hc", "hw", "rc", "rw").alias("per_ref"))

    out = st.select(*keys, "example_id", best_chrf(F.col("per_ref"), orders, beta).alias("best"))
    return out.select(*keys, "example_id", F.col("best.k").alias("best_ref"),
                      F.col("best.stats").alias("stats"), F.col("best.f").alias("chrf"))


def corpus_chrf(pairs: DataFrame, keys: list[str], char_order: int = CHAR_ORDER, word_order: int = WORD_ORDER,
                beta: float = BETA, name: str = "chrf_pp", partitioned: bool = True) -> DataFrame:
    """Corpus chrF++ per group: sums of the best-reference statistics of every
    example (one partial aggregation of 3 × orders integers), then the same F
    formula."""
    orders = char_order + word_order
    st = chrf_stats(pairs, keys, char_order, word_order, beta, partitioned)
    sums = st.groupBy(*keys).agg(*[F.sum(F.col("stats")[o][f]).alias(f"{f}{o}")
                                   for o in range(orders) for f in ("h", "r", "m")])
    column = lambda f: [F.col(f"{f}{o}") for o in range(orders)]
    return sums.select(*keys, chrf_from_sums(column("h"), column("r"), column("m"), beta).alias(name))

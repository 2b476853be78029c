"""Sequence-alignment metrics: ROUGE-L, TER (with shifts), shift-free word
edit rate and exact-match METEOR.

Same plan shape as ``ngram``: JVM tokenisation → per-row Arrow kernel over the
row's token arrays (``lexeval.operators.kernels``) → best reference chosen by
a higher-order expression → one partial aggregation per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeval.functions.text import meteor_tokens, rouge_tokens, ter_tokens
from lexeval.metrics.ngram import by_example, predicted, usable_refs
from lexeval.operators import kernels
from lexeval.operators.tokens import lookup


def _best(arr, better):
    """First element of ``arr`` (array of structs with field ``k``) that is best
    under the ``better(a, b)`` boolean; ties keep the earlier reference."""
    return F.get(F.array_sort(arr, lambda a, b: F.when(better(a, b), -1).when(better(b, a), 1)
                              .otherwise(a["k"] - b["k"])), F.lit(0))


def rouge_scores(hl, sizes, lcs):
    """``array<struct<k,p,r,f>>``: precision, recall and F1 of each reference
    from its number of tokens, the prediction's ``hl``, and the length of their
    LCS; an empty side gives 0."""
    def score(size, k):
        n = F.get(lcs, k)
        return F.transform(F.array(F.struct(F.when(hl > 0, n / hl).otherwise(0.0).alias("p"), F.when(size > 0, n / size).otherwise(0.0).alias("r"))), lambda x: F.struct(
            k.alias("k"), x["p"].alias("p"), x["r"].alias("r"),
            F.when(x["p"] + x["r"] > 0, 2 * x["p"] * x["r"] / (x["p"] + x["r"])).otherwise(0.0).alias("f")))[0]

    return F.transform(sizes, score)


# ------------------------------------------------------------ ROUGE-L
def rouge_l_per_example(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per example: LCS precision, recall and F1 of the reference with the
    highest F1 (lower-case ``[a-z0-9]+`` tokens; empty side → 0)."""
    base = by_example(pairs).select(*keys, "example_id", rouge_tokens(predicted()).alias("h"),
                                    F.transform(usable_refs(), lambda r: rouge_tokens(r)).alias("rs"))
    st = base.select(*keys, "example_id", "h", "rs", kernels.lcs_udf("h", "rs").alias("lcs"))
    best = _best(rouge_scores(F.size("h"), F.transform("rs", F.size), F.col("lcs")), lambda a, b: a["f"] > b["f"])
    out = st.select(*keys, "example_id", best.alias("b"))
    return out.select(*keys, "example_id", F.col("b.p").alias("rougeL_precision"),
                      F.col("b.r").alias("rougeL_recall"), F.col("b.f").alias("rougeL"))


def rouge_l(pairs: DataFrame, keys: list[str], name: str = "rougeL") -> DataFrame:
    """Corpus ROUGE-L = exact mean of per-example best F1 (the library default
    reports a bootstrap midpoint, which is random; the mean is its expectation)."""
    return rouge_l_per_example(pairs, keys).groupBy(*keys).agg(F.avg("rougeL").alias(name))


# ------------------------------------------------------------ TER
def edit_stats(pairs: DataFrame, keys: list[str], shifts: bool = True, case_sensitive: bool = False) -> DataFrame:
    """Per example: ``edits`` (fewest edits over references) and ``ref_len``
    (mean reference length in words)."""
    base = by_example(pairs).select(*keys, "example_id", ter_tokens(predicted(), case_sensitive).alias("h"),
                        F.transform(usable_refs(), lambda r: ter_tokens(r, case_sensitive)).alias("rs"))
    udf = kernels.ter_udf if shifts else kernels.word_edit_udf
    st = base.select(*keys, "example_id", "rs", udf("h", "rs").alias("e"))
    n = F.size("rs")
    return st.select(*keys, "example_id",
                     F.when(n > 0, F.array_min("e")).alias("edits"),
                     F.when(n > 0, F.aggregate("rs", F.lit(0).cast("long"), lambda a, r: a + F.size(r)) / n)
                     .alias("ref_len"))


def ter_from_sums(edits, ref_len):
    return F.when(edits.isNotNull(), F.when(ref_len > 0, 100.0 * edits / ref_len).when(edits > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def ter(pairs: DataFrame, keys: list[str], name: str = "ter", shifts: bool = True,
        case_sensitive: bool = False) -> DataFrame:
    """Corpus TER = 100 · Σ best edits / Σ mean reference length."""
    st = edit_stats(pairs, keys, shifts, case_sensitive)
    s = st.groupBy(*keys).agg(F.sum("edits").alias("e"), F.sum("ref_len").alias("l"))
    return s.select(*keys, ter_from_sums(F.col("e"), F.col("l")).alias(name))


def word_edit_rate(pairs: DataFrame, keys: list[str], name: str = "word_edit_rate") -> DataFrame:
    """TER without block shifts (plain word Levenshtein distance)."""
    return ter(pairs, keys, name=name, shifts=False)


# ------------------------------------------------------------ METEOR
def meteor_per_example(pairs: DataFrame, keys: list[str], classes: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """Per example: best METEOR over the references (α = 0.9, β = 3, γ = 0.5).
    Exact word matches first; in a second stage remaining words match whose
    English stems are equal (``stem``), or whose classes are, with ``classes``, a
    ``(token, cls)`` table of any size, such as synonym sets or other stems."""
    if stem and classes is not None:
        raise ValueError("the second stage takes stems or a class table, not both")
    base = by_example(pairs).select(*keys, "example_id", meteor_tokens(predicted()).alias("h"),
                                    F.transform(usable_refs(), lambda r: meteor_tokens(r)).alias("rs"))
    if classes is None:
        st = base.select(*keys, "example_id", (kernels.meteor_stem_udf if stem else kernels.meteor_udf)("h", "rs").alias("s"))
    else:  # array 0 is the prediction, array k + 1 reference k
        part = lambda a, c: F.transform(a, lambda t, i: F.struct(c.alias("c"), i.alias("p"), t.alias("t")))
        texts = F.concat(part(F.col("h"), F.lit(0)), F.flatten(F.transform("rs", lambda r, k: part(r, k + 1))))
        found = lookup(base.withColumn("n", F.size("rs")), [*keys, "example_id", "n"], texts, classes, "token", "cls", words=True)
        st = found.select(*keys, "example_id", kernels.meteor_found_udf("found", "n").alias("s"))
    return st.select(*keys, "example_id", F.array_max("s").alias("meteor"))


def meteor(pairs: DataFrame, keys: list[str], name: str = "meteor", classes: DataFrame | None = None, stem: bool = False) -> DataFrame:
    return meteor_per_example(pairs, keys, classes, stem).groupBy(*keys).agg(F.avg("meteor").alias(name))

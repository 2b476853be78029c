"""Dataset recipes: normalise a dataset shape to ``(input, target)`` pairs or to
a multi-reference evaluation table.  All functions are ``DataFrame → DataFrame``
and only use built-in expressions (no Python per row).

A dataset is one DataFrame with a ``split`` column (train/validation/test) and
an explicit ``example_id``; rows are never identified by position.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


# P1
def rename_dialogue_acts(df: DataFrame) -> DataFrame:
    """``text → target``, ``da → input``."""
    return df.withColumnsRenamed({"text": "target", "da": "input"})


# P3
def translation_pairs(df: DataFrame, source_lang: str = "en", target_lang: str = "cs") -> DataFrame:
    """``input = translation[source_lang]``, ``target = translation[target_lang]``;
    every other column is kept."""
    t = F.col("translation")
    return df.withColumns({"input": t[source_lang], "target": t[target_lang]})


# P4
def filter_lexicalizations(df: DataFrame, target_lang: str = "cs", lex_source: str = "deepl",
                           column: str = "lex") -> DataFrame:
    """Replace ``lex{text,lang,source}`` (parallel arrays) by the ``array<string>``
    of texts whose language equals ``target_lang`` and whose source contains
    ``lex_source`` (case-sensitive substring).  Parallel arrays of unequal
    length are cut to the shortest; rows are never dropped."""
    lex = F.col(column)
    text, lang, src = lex["text"], lex["lang"], lex["source"]
    n = F.least(*[F.coalesce(F.size(a), F.lit(0)) for a in (text, lang, src)])
    kept = F.filter(
        F.transform(F.slice(F.coalesce(text, F.array().cast("array<string>")), 1, n),
                    lambda t, i: F.struct(t.alias("text"), F.get(lang, i).alias("lang"),
                                          F.get(src, i).alias("source"))),
        lambda x: (x["lang"] == F.lit(target_lang)) & F.contains(x["source"], F.lit(lex_source)))
    return df.withColumn(column, F.transform(kept, lambda x: x["text"]))


# P5
def linearise_triples(df: DataFrame, column: str = "modified_triple_sets", sep: str = " - ") -> DataFrame:
    """``input`` = the strings of the one and only triple set joined by ``sep``.
    A row with zero or several sets, or a NULL triple, fails the job."""
    s = F.col(column)["mtriple_set"]
    first = F.get(s, 0)
    value = (F.when(F.coalesce(F.size(s), F.lit(-1)) != 1,
                    F.raise_error(F.lit("expected exactly one triple set per example")))
             .when(F.exists(first, lambda x: x.isNull()),
                   F.raise_error(F.lit("NULL triple in a triple set")))
             .otherwise(F.array_join(first, sep)))
    return df.withColumn("input", value)


# P2 / P9
def multi_reference(df: DataFrame, column: str = "lex") -> DataFrame:
    """The multi-reference branch: ``(example_id, input, references)``."""
    return df.withColumnRenamed(column, "references")


# P6
def flatten_first(df: DataFrame, column: str = "lex", keys=("example_id",)) -> DataFrame:
    """``(input, first reference)``; rows without references disappear."""
    return (df.where(F.size(column) > 0)
            .select(*keys, "input", F.get(F.col(column), 0).alias("target")))


# P7
def flatten_all(df: DataFrame, column: str = "lex", keys=("example_id",)) -> DataFrame:
    """One row per ``(input, reference)``; rows without references disappear."""
    return df.select(*keys, "input", F.explode(column).alias("target"))


def flatten_by_split(df: DataFrame, column: str = "lex", keys=("example_id", "split"),
                     all_for: tuple[str, ...] = ("train",)) -> DataFrame:
    """Train split flattened to all references, the others to the first one —
    a single generator, no union of branches."""
    c = F.col(column)
    chosen = F.when(F.col("split").isin(*all_for), c).otherwise(F.slice(c, 1, 1))
    return df.select(*keys, "input", F.explode(chosen).alias("target"))


# C1
def select_subset(df: DataFrame, limits: Mapping[str, int | None], order_by: str = "example_id",
                  split_col: str = "split") -> DataFrame:
    """Per split, the first ``n`` examples in ``order_by`` order (``None`` = all,
    ``0`` = none).  One scan serves all limited splits: each task keeps at most
    the largest limit of rows a split before they meet.  Splits without a limit,
    a NULL split among them, pass through unchanged."""
    limited = {s: int(n) for s, n in limits.items() if n is not None}
    if not limited:
        return df
    of = F.col(split_col)
    chosen = df.where(of.isin(*[s for s, n in limited.items() if n > 0]))
    rank = "__rank"
    first = chosen.withColumn(rank, F.row_number().over(Window.partitionBy(split_col).orderBy(order_by))).where(F.col(rank) <= max(limited.values()))
    own = F.create_map(*[F.lit(x) for pair in limited.items() for x in pair])
    first = first.where(F.col(rank) <= own[of]).drop(rank)
    return first.unionByName(df.where(~F.coalesce(of.isin(*limited), F.lit(False))))


# P10 recipe registry -------------------------------------------------------
def _web_nlg(df: DataFrame, target_lang: str = "cs", lex_source: str = "deepl") -> dict[str, DataFrame]:
    prepared = linearise_triples(filter_lexicalizations(df, target_lang, lex_source))
    return {
        "pairs": flatten_by_split(prepared),
        "multi_reference": multi_reference(prepared).select("example_id", "split", "input", "references"),
    }


def _single(fn: Callable[[DataFrame], DataFrame]):
    def run(df: DataFrame, **kw) -> dict[str, DataFrame]:
        p = fn(df, **kw)
        return {"pairs": p,
                "multi_reference": p.withColumn("references", F.array(F.col("target")))}
    return run


RECIPES: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "cs_restaurants": _single(rename_dialogue_acts),
    "wmt19": _single(translation_pairs),
    "web_nlg": _web_nlg,
    "custom": _single(lambda df: df),
}


def prepare(df: DataFrame, dataset_name: str | None, **kw) -> dict[str, DataFrame]:
    """Dispatch on the dataset name (exact for the first two, substring for the
    triples dataset); unknown or missing names use the identity recipe, which
    needs ``input`` and ``target`` columns.  Every recipe returns both the
    training pairs and a multi-reference table (single-target datasets get a
    one-element ``references`` array)."""
    if dataset_name in ("cs_restaurants", "wmt19"):
        return RECIPES[dataset_name](df, **kw)
    if dataset_name and "web_nlg" in dataset_name:
        return RECIPES["web_nlg"](df, **kw)
    missing = {"input", "target"} - set(df.columns)
    if missing:
        raise ValueError(f"custom dataset needs columns input, target; missing {sorted(missing)}")
    return RECIPES["custom"](df)

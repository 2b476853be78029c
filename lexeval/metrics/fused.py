"""All light metrics in one pass over the aligned rows.

Scoring a run with several metric families one after another reads and
ships every row to Python once per family.  Here one Arrow kernel takes the
texts of a row once, cuts them into the tokens of every selected family
(``functions.pytokens``; token columns, families times references, cost several
times the counting) and returns every family's per-row statistics, the best
reference is chosen per family with higher-order expressions, and a single
partial aggregation per group yields all corpus scores.  Results equal the per-family functions
(same definitions, same reference selection rules).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexeval.functions import pytokens
from lexeval.functions.text import chrf_chars, chrf_words, meteor_tokens, rouge_tokens, split_ws, ter_tokens, tok_13a
from lexeval.metrics.ngram import best_chrf, bleu_from_sums, by_example, chrf_from_sums, over, predicted, usable_refs
from lexeval.metrics.sequence import rouge_scores, ter_from_sums
from lexeval.operators import kernels

FUSABLE = ("BLEU", "BLEU_lower", "chrF++", "TER", "word_edit_rate", "rougeL", "meteor", "gen_len")
ORDERS = 8  # chrF++: 6 character + 2 word orders

_LL = T.ArrayType(T.LongType())
_OUT = T.StructType([
    T.StructField("b", T.ArrayType(T.LongType())),       # hyp_len, ref_len, m1..m4
    T.StructField("bl", T.ArrayType(T.LongType())),
    T.StructField("c", T.ArrayType(_LL)),                  # per reference: [h, r, m] * 8
    T.StructField("tl", _LL),                              # words of each reference
    T.StructField("t", _LL),                               # TER edits per reference
    T.StructField("w", _LL),                               # word edit distance per reference
    T.StructField("rl", _LL),                              # ROUGE tokens of the prediction, then of each reference
    T.StructField("l", _LL),                               # LCS per reference
    T.StructField("mt", T.ArrayType(T.ArrayType(T.DoubleType()))),  # METEOR per setting and reference
])

#: Settings of each metric and their defaults.
SETTINGS: dict[str, dict] = {
    "BLEU": {"max_order": 4, "lowercase": False}, "BLEU_lower": {"max_order": 4},
    "chrF++": {"char_order": 6, "word_order": 2, "beta": 2.0},
    "TER": {}, "word_edit_rate": {}, "rougeL": {}, "gen_len": {},
    "meteor": {"alpha": 0.9, "beta": 3.0, "gamma": 0.5, "stem": False}}
_MOST = {"max_order": (1, 4), "char_order": (1, 6), "word_order": (0, 2)}


@dataclass(frozen=True)
class Spec:
    """A metric with settings, under the name of its result column."""
    label: str
    metric: str
    config: Mapping = field(default_factory=dict, hash=False)

    def settings(self) -> dict:
        known = SETTINGS[self.metric]
        strange = set(self.config) - set(known)
        if strange:
            raise ValueError(f"{self.metric} has no setting {sorted(strange)}; it has {sorted(known)}")
        out = known | dict(self.config)
        for name, (low, high) in _MOST.items():
            if name in out and not low <= out[name] <= high:
                raise ValueError(f"{self.metric}: {name} is {out[name]}, not in {low} to {high}")
        return out

    def family(self) -> str:
        """The metric whose tokens and kernel serve this one."""
        return "BLEU_lower" if self.metric == "BLEU" and self.settings()["lowercase"] else self.metric


def specs_of(metrics) -> list[Spec]:
    """Names, specs, or a mapping ``{label: settings | metric | (metric,
    settings)}``: ``{"chrF++": {"word_order": 1}, "chrF": ("chrF++", {"word_order": 0})}``."""
    if not isinstance(metrics, Mapping):
        return [m if isinstance(m, Spec) else Spec(m, m) for m in metrics]
    out = []
    for label, what in metrics.items():
        if isinstance(what, str):
            what = (what, {})
        elif what is None or isinstance(what, Mapping):
            what = (label, what or {})
        out.append(Spec(label, what[0], dict(what[1])))
    return out


def _meteor_settings(specs: list[Spec]) -> list[tuple]:
    """The distinct METEOR settings, in order; the kernel returns one list of scores for each."""
    return list(dict.fromkeys(tuple(s.settings().values()) for s in specs if s.metric == "meteor"))


def _kernel(sel: frozenset, names: list[str], meteor: tuple = (tuple(SETTINGS["meteor"].values()),)):
    """The kernel over the columns of :func:`kernel_columns`, by their names."""
    @F.pandas_udf(_OUT)
    def run(*columns: pd.Series) -> pd.DataFrame:
        given = dict(zip(names, columns))
        n = len(columns[0])
        out = {f.name: [None] * n for f in _OUT.fields}
        text = lambda c: given[c].tolist()

        def cut(hyps, refs, known, f):
            """Tokens of the predictions and, unless known, of their references."""
            held = given[known].tolist() if known in given else [[f(r) for r in rs] for rs in text(refs)]
            return [f(h) for h in text(hyps)], held

        for m, key, hyps, refs, known in (("BLEU", "b", "p", "r", "br"), ("BLEU_lower", "bl", "pl", "rl", "lr")):
            if m in sel:
                h, r = cut(hyps, refs, known, pytokens.tok_13a)
                out[key] = [[hl, rl, *match] if len(x) else None for (hl, rl, match), x in zip(kernels.bleu_batch(h, r), r)]
        if "chrF++" in sel:
            (hc, rc), (hw, rw) = cut("p", "r", "crc", pytokens.chrf_chars), cut("p", "r", "crw", pytokens.chrf_words)
            out["c"] = kernels.chrf_batch(hc, hw, rc, rw)
        if sel & {"TER", "word_edit_rate"}:
            h, r = cut("pl", "rl", "tr", str.split)
            out["tl"] = [[len(x) for x in rs] for rs in r]
            if "TER" in sel:
                out["t"] = [[kernels.ter_edits(x, y) for y in rs] for x, rs in zip(h, r)]
            if "word_edit_rate" in sel:
                out["w"] = [[kernels.edit_distance(x, y) for y in rs] for x, rs in zip(h, r)]
        if "rougeL" in sel:
            h, r = cut("pl", "rl", "rr", pytokens.rouge_tokens)
            out["rl"] = [[len(x), *map(len, rs)] for x, rs in zip(h, r)]
            out["l"] = [[kernels.lcs_len(y, x) for y in rs] for x, rs in zip(h, r)]
        if "meteor" in sel:
            words = lambda t, beyond: pytokens.meteor_tokens(t) if t.isascii() else beyond
            h = [words(*x) for x in zip(text("pl"), text("mh"))]
            r = text("mr") if "mr" in given else [[words(*y) for y in zip(*x)] for x in zip(text("rl"), text("mx"))]
            out["mt"] = [[s for s in each] for each in zip(*[[kernels.meteor_rows(x, rs, *how) for x, rs in zip(h, r)] for how in meteor])]
        return pd.DataFrame(out)

    return run


_S, _SS = "array<string>", "array<array<string>>"


def family_tokens(sel) -> set[str]:
    """Names of the reference tokens that the metrics of ``sel`` read."""
    of = {"BLEU": ("br",), "BLEU_lower": ("lr",), "chrF++": ("crc", "crw"), "TER": ("tr",), "word_edit_rate": ("tr",), "rougeL": ("rr",), "meteor": ("mr",), "gen_len": ()}
    return {n for m in sel for n in of[m]}


def reference_columns(sel, refs=None) -> dict:
    """Tokens of the usable references, by argument name: the part of the work
    that does not depend on a prediction.  A family that is not selected has
    empty columns."""
    refs = usable_refs() if refs is None else refs
    words = sel & {"TER", "word_edit_rate"}
    each = lambda on, f, kind: F.transform(refs, f) if on else F.array().cast(kind)
    return {"br": each("BLEU" in sel, lambda r: tok_13a(r), _SS), "lr": each("BLEU_lower" in sel, lambda r: tok_13a(r, True), _SS),
            "crc": each("chrF++" in sel, lambda r: chrf_chars(r), _S), "crw": each("chrF++" in sel, lambda r: chrf_words(r), _SS),
            "tr": each(words, lambda r: ter_tokens(r), _SS), "rr": each("rougeL" in sel, lambda r: rouge_tokens(r), _SS),
            "mr": each("meteor" in sel, lambda r: meteor_tokens(r), _SS)}


def kernel_columns(sel, known=()) -> list:
    """The kernel's arguments: the prediction ``p`` and its references ``r``, both
    lower-cased as ``pl`` and ``rl``, METEOR tokens of texts beyond ASCII as
    ``mh`` and ``mx``; no text that the selected families do not read.  Reference
    tokens that the rows already hold (see ``metrics.shared``) are taken as they
    are, by the names of :func:`reference_columns`."""
    known = {n for n in reference_columns(sel) if f"_ref_{n}" in set(known) and n in family_tokens(sel)}
    plain, lowered = sel & {"BLEU", "chrF++"}, sel & {"BLEU_lower", "TER", "word_edit_rate", "rougeL", "meteor"}
    low, refs = F.lower(predicted()), usable_refs()
    beyond = lambda t: F.when(F.length(t) != F.octet_length(t), meteor_tokens(t))
    cols = {"p": predicted() if plain else F.lit("")}
    cols |= {"pl": low} if lowered else {}
    cols |= {"mh": beyond(low)} if "meteor" in sel else {}
    cols |= {n: F.col(f"_ref_{n}") for n in sorted(known)}
    cols |= {"r": refs} if family_tokens(plain) - known else {}
    cols |= {"rl": F.transform(refs, F.lower)} if family_tokens(lowered) - known else {}
    cols |= {"mx": F.transform(refs, lambda t: beyond(F.lower(t)))} if family_tokens(sel & {"meteor"}) - known else {}
    return [c.alias(f"_k_{n}") for n, c in cols.items()]


def _called(base: DataFrame, sel, *how) -> Column:
    """The kernel over the columns that ``base`` has for it."""
    given = [c for c in base.columns if c.startswith("_k_")]
    return _kernel(sel, [c.removeprefix("_k_") for c in given], *how)(*given)


def _picked(places: list[int]):
    return lambda r: F.array(*[r[x] for x in places])


def _columns(specs: list[Spec]) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Columns made once a row, statistics over them, and scores over the statistics' sums."""
    unknown = {s.metric for s in specs} - set(FUSABLE)
    if unknown:
        raise KeyError(f"not fusable: {sorted(unknown)}")
    how = _meteor_settings(specs)
    rows: dict[str, Column] = {}
    stats: dict[str, Column] = {}
    scores: dict[str, Column] = {}
    n_refs = F.size(F.col("s")["tl"])
    ref_len = F.aggregate(F.col("s")["tl"], F.lit(0).cast("long"), lambda a, n: a + n) / n_refs
    for i, spec in enumerate(specs):
        name, c, m = lambda x, i=i: f"_{i}_{x}", spec.settings(), spec.metric  # noqa: B023
        col = lambda x, name=name: F.col(name(x))
        if m in ("BLEU", "BLEU_lower"):
            v, orders = F.col("s")["b" if spec.family() == "BLEU" else "bl"], range(c["max_order"])
            stats |= {name("sys"): v[0], name("ref"): v[1]}
            stats |= {name(f"m{n}"): v[2 + n] for n in orders} | {name(f"t{n}"): over(v[0], n) for n in orders}
            scores[spec.label] = bleu_from_sums(col("sys"), col("ref"), [col(f"m{n}") for n in orders], [col(f"t{n}") for n in orders])
        elif m == "chrF++":
            n_orders = c["char_order"] + c["word_order"]
            flat = F.col("s")["c"]
            if (c["char_order"], c["word_order"]) != (ORDERS - 2, 2):  # the first orders of each kind
                pick = [*range(3 * c["char_order"]), *range(18, 18 + 3 * c["word_order"])]
                flat = F.transform(flat, _picked(pick))
            rows[name("best")] = best_chrf(flat, n_orders, c["beta"])["stats"]
            stats |= {name(f"{f}{o}"): col("best")[o][f] for o in range(n_orders) for f in "hrm"}
            scores[spec.label] = chrf_from_sums(*[[col(f"{f}{o}") for o in range(n_orders)] for f in "hrm"], beta=c["beta"])
        elif m in ("TER", "word_edit_rate"):
            rows |= {name("e"): F.when(n_refs > 0, F.array_min(F.col("s")["t" if m == "TER" else "w"])), name("l"): F.when(n_refs > 0, ref_len)}
            stats |= {name("e"): col("e"), name("l"): col("l")}
            scores[spec.label] = ter_from_sums(col("e"), col("l"))
        else:  # a mean over the examples that have a score
            if m == "gen_len":  # words of the prediction and the end of sequence; asks for no reference
                each = F.col("gl").cast("double")
            elif m == "rougeL":
                each = F.array_max(F.transform(rouge_scores(F.get(F.col("s")["rl"], F.lit(0)), F.slice(F.col("s")["rl"], 2, 1 << 30), F.col("s")["l"]), lambda x: x["f"]))
            else:
                each = F.array_max(F.col("s")["mt"][how.index(tuple(c.values()))])
            rows[name("v")] = each
            stats |= {name("v"): col("v"), name("n"): col("v").isNotNull().cast("long")}
            scores[spec.label] = F.when(col("n") > 0, col("v") / col("n"))
    return rows, stats, scores


def score_columns(specs: list[Spec]) -> dict[str, Column]:
    """``label -> expression`` over the sums of the statistics of :func:`statistics`."""
    return _columns(specs)[2]


def statistics(pairs: DataFrame, keys: list[str], specs: list[Spec]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """What every corpus score is made of: rows, one an example; statistics of a
    row (``name -> number``, NULL where it counts in no score); and scores
    (``label -> expression``) over columns of those names that hold their sums.
    Sums over any parts of the rows add up, so they can be stored, merged,
    weighted or replaced (``metrics.bootstrap``, ``plans.rescore``)."""
    rows, stats, scores = _columns(specs)
    sel = frozenset(s.family() for s in specs)
    length = F.size(split_ws(predicted())) + 1 if "gen_len" in sel else F.lit(None).cast("int")
    given = kernel_columns(sel, pairs.columns)
    base = by_example(pairs).select(*keys, "example_id", length.alias("gl"), *given)
    st = base.select(*keys, "example_id", "gl", _called(base, sel, tuple(_meteor_settings(specs))).alias("s"))
    return st.select(*keys, "example_id", *[c.alias(n) for n, c in rows.items()], "s"), stats, scores


def evaluate_fused(pairs: DataFrame, keys: list[str], metrics) -> DataFrame:
    """``metrics`` as for :func:`specs_of`: any number of settings of a metric
    share its tokens and one kernel call a row."""
    rows, stats, scores = statistics(pairs, keys, specs_of(metrics))
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in stats.items()], F.count("*").alias("_rows"))
    # an empty input (global summary, no keys) gives one row of NULL metrics
    return sums.select(*keys, *[F.when(F.col("_rows") > 0, c).alias(label) for label, c in scores.items()])


def per_example_fused(pairs: DataFrame, keys: list[str], carry=("source", "prediction", "references")) -> DataFrame:
    """Per-example rows with sentence chrF++ (best reference) and METEOR
    computed in the same narrow pass that carries the example columns — no
    join back to the examples."""
    sel = frozenset({"chrF++", "meteor"})
    carried = [c for c in carry if c in pairs.columns]
    base = by_example(pairs).select(*keys, "example_id", *carried, *kernel_columns(sel, pairs.columns))
    st = base.select(*keys, "example_id", *carried, _called(base, sel).alias("s"))

    return st.select(*keys, "example_id", *carried, best_chrf(F.col("s")["c"], ORDERS)["f"].alias("chrf"),
                     F.array_max(F.col("s")["mt"][0]).alias("meteor"))

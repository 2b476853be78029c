"""Embedding-match scores (greedy cosine matching of token embeddings, the
BERTScore formula without idf weights or baseline rescaling).

Input: a token table ``(example_id, side 'cand'|'ref', ref_idx, tok, embedding)``.
Per example and reference: ``P = mean over candidate tokens of the best cosine
with any reference token``, ``R`` the same the other way, ``F = 2PR/(P+R)``;
several references → the maximum of each of P, R, F; corpus = mean.

Greedy matching needs every candidate/reference similarity.  They are computed
in tiles: tokens are cut into blocks of at most ``block`` tokens per
(example, side, reference); one row per pair of blocks carries two bounded
matrices into an Arrow kernel (one matrix product), which returns the per-token
maxima inside the tile.  A further max over tiles and a mean give P and R.  No
row ever holds more than ``block`` vectors per side, so a huge example is split
across many tasks instead of landing in one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = T.StructType([
    T.StructField("cand_max", T.ArrayType(T.DoubleType())),
    T.StructField("ref_max", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(TILE)
def _tile_max(cv: pd.Series, rv: pd.Series) -> pd.DataFrame:
    cm, rm = [], []
    for a, b in zip(cv, rv):
        A = np.vstack([np.asarray(x, dtype=np.float64) for x in a])
        B = np.vstack([np.asarray(x, dtype=np.float64) for x in b])
        S = A @ B.T
        cm.append(S.max(axis=1).tolist())
        rm.append(S.max(axis=0).tolist())
    return pd.DataFrame({"cand_max": cm, "ref_max": rm})


def _unit(c):
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / norm)


def embedding_match_per_example(tokens: DataFrame, block: int = 256, keys=()) -> DataFrame:
    """Per ``(keys..., example_id)`` of ``tokens``: best P, R and F over the
    references; an example without candidate or reference tokens has NULLs.
    Candidates differ by ``keys`` (a run, a step), references may be shared:
    rows of side 'ref' with NULL keys serve all of them."""
    keys = list(keys)
    one = [*keys, "example_id"]
    t = tokens.select(*one, "side", F.coalesce("ref_idx", F.lit(-1)).alias("ref_idx"), "tok", _unit(F.col("embedding")).alias("u"))
    # blocks by hash: their number follows the size of the side, so a block holds about ``block`` tokens
    size = t.groupBy(*one, "side", "ref_idx").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*one, "side", "ref_idx")]
    t = t.alias("t").join(size.alias("s"), on).select("t.*", F.pmod(F.xxhash64("t.tok"), F.col("s.n")).alias("blk"))
    blocks = t.groupBy(*one, "side", "ref_idx", "blk").agg(F.sort_array(F.collect_list(F.struct("tok", "u"))).alias("items"))
    cand = blocks.where(F.col("side") == "cand").select(*one, F.col("items").alias("ci"))
    ref = blocks.where(F.col("side") == "ref").select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("example_id").alias("r_example"),
                                                      "ref_idx", F.col("items").alias("ri"))
    same = F.col("example_id") == F.col("r_example")
    for k in keys:
        same = same & (F.col(f"r_{k}").isNull() | (F.col(k) == F.col(f"r_{k}")))
    tiles = cand.join(ref, same).select(*one, "ref_idx", "ci", "ri", _tile_max(
        F.transform("ci", lambda x: x["u"]), F.transform("ri", lambda x: x["u"])).alias("m"))
    # both directions of a tile as rows (side, token, best in the tile): the tile is computed once
    of = lambda side, toks, best: F.transform(F.arrays_zip(F.transform(toks, lambda x: x["tok"]).alias("tok"), best.alias("s")),
                                              lambda x: F.struct(F.lit(side).alias("side"), x["tok"].alias("tok"), x["s"].alias("s")))
    rows = tiles.select(*one, "ref_idx", F.explode(F.concat(of("cand", F.col("ci"), F.col("m.cand_max")),
                                                            of("ref", F.col("ri"), F.col("m.ref_max")))).alias("x"))
    best = rows.groupBy(*one, "ref_idx", "x.side", "x.tok").agg(F.max("x.s").alias("s"))
    side = lambda name: F.avg(F.when(F.col("side") == name, F.col("s")))
    pr = best.groupBy(*one, "ref_idx").agg(side("cand").alias("P"), side("ref").alias("R"))
    pr = pr.withColumn("F", F.when(F.col("P") + F.col("R") != 0, 2 * F.col("P") * F.col("R") / (F.col("P") + F.col("R"))).otherwise(0.0))
    found = pr.groupBy(*one).agg(F.max("P").alias("emb_precision"), F.max("R").alias("emb_recall"), F.max("F").alias("emb_f1"))
    every = tokens.select(*one).distinct()
    for k in keys:  # shared reference rows are no group of their own
        every = every.where(F.col(k).isNotNull())
    return every.join(found, one, "left")


def embedding_match(tokens: DataFrame, block: int = 256, keys=()) -> DataFrame:
    e = embedding_match_per_example(tokens, block, keys)
    return e.groupBy(*keys).agg(F.avg("emb_precision").alias("emb_precision"), F.avg("emb_recall").alias("emb_recall"),
                                F.avg("emb_f1").alias("emb_f1"))

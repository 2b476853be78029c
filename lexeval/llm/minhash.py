"""Near-duplicate documents: MinHash bands, sequential Bayesian verification of
the candidates, exact Jaccard of the survivors, connected components.

Definition.  Words are runs of non-white-space with A-Z lower-cased; a
document's set is its distinct shingles of ``shingle`` words, the whole word
sequence if it has fewer, nothing if it has none.  Two documents are linked if
their sets' Jaccard similarity reaches ``percent`` / 100.

Defined cases.  Null and empty texts have an empty set and link with nothing.
Equal sets are one vertex from the start, so groups of copies, however large,
are never paired.  Rows that share a ``doc_id`` are one document (one vertex).
Rows with a null ``doc_id`` take part in no link; their component is null and
they are kept.  An empty table gives an empty result.  Other columns are not
read.

Recall.  ``banding`` takes the longest bands that miss a pair at the threshold
with a probability of at most ``BAND_MISS`` (28 bands of 7 hashes at 0.85, 39 of
5 at 0.8), and less above it.  The sequential test prunes a pair only when P(similarity >= threshold | matches so far) under
a uniform prior is below ``MISS``.  Survivors are compared on full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeval.llm import components as C
from lexeval.llm.common import stage
from lexeval.llm.words import SPACED, mix, windows, words

#: Hashes that bands are made of, and the chosen probability that no band of a pair at the threshold agrees.
BAND_HASHES, BAND_MISS = 196, 3e-5
#: Length of the verification signature, and how much of it one step of the sequential test looks at.
HASHES, STEP = 512, 32
#: Chosen probability to prune a pair that does reach the threshold.
MISS = 1e-5
#: Members of one side of a comparison tile.
TILE = 512
#: Candidate ids up to this many (16 bytes each) are broadcast to pick their texts.
BROADCAST_IDS = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 31, BAND_HASHES + HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BAND_HASHES + HASHES, dtype=np.uint32)
#: The band hashes and, independent of them, those of the verification signature.
_BAND, _VERIFY = slice(0, BAND_HASHES), slice(BAND_HASHES, None)
_BAND_SEED = _rng.integers(0, 1 << 63, BAND_HASHES, dtype=np.uint64)
_BAND_MUL = _rng.integers(0, 1 << 62, BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows a band)."""
    miss = lambda r: (1 - (percent / 100) ** r) ** (BAND_HASHES // r)
    rows = max([r for r in range(1, 33) if miss(r) <= BAND_MISS], default=1)
    return BAND_HASHES // rows, rows


def shingle_sets(column, size: int):
    """Sorted distinct shingle hashes of each row of a string column."""
    hashes, bounds = words(column, SPACED)
    grams = windows(hashes, size)
    for i in range(len(bounds) - 1):
        lo, hi = bounds[i], bounds[i + 1]
        if hi - lo >= size:
            yield np.unique(grams[lo:hi - size + 1])
        elif hi > lo:
            yield windows(hashes[lo:hi], int(hi - lo))
        else:
            yield hashes[:0]


def signature(values: np.ndarray, part: slice) -> np.ndarray:
    x, a, b = (values >> np.uint64(32)).astype(np.uint32), _A[part], _B[part]
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i:i + 256, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(sigs: list[np.ndarray], percent: int) -> np.ndarray:
    """One key for each band of each band signature."""
    n_bands, n_rows = banding(percent)
    sig = np.stack(sigs)[:, :n_bands * n_rows].reshape(-1, n_bands, n_rows).astype(np.uint64)
    return mix((sig * _BAND_MUL[:n_rows]).sum(axis=2, dtype=np.uint64) + _BAND_SEED[:n_bands])


def _sign(size: int, percent: int):
    n_bands, _ = banding(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            n, s1, s2, sigs = [], [], [], []
            for u in shingle_sets(batch.column("text"), size):
                n.append(len(u))
                s1.append(int(u.sum(dtype=np.uint64)))
                s2.append(int(mix(u).sum(dtype=np.uint64)))
                sigs.append(signature(u, _BAND))
            if not n:
                continue
            key = band_keys(sigs, percent)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * n_bands),
                                             pa.array(key.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                 pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                 lists], schema=schema)

    return run


def _signatures(size: int, percent: int):
    """(id, sig, bands) of (id, text): one byte of each verification hash, and the band keys."""
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), size))
            if sets:
                sigs = [(signature(u, _VERIFY) >> np.uint32(8)).astype(np.uint8).tobytes() for u in sets]
                keys = [k.tobytes() for k in band_keys([signature(u, _BAND) for u in sets], percent)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary())],
                                                 names=["id", "sig", "bands"])
    return run


def least_matches(percent: int) -> np.ndarray:
    """For each step of the sequential test the fewest matches that keep a
    pair: with ``m`` of ``n`` matching, similarity has the posterior
    Beta(m + 1, n - m + 1); below MISS at the threshold the pair goes.  The
    tail of that Beta is P(Binomial(n + 1, t) <= m).  Signatures are compared
    by one byte a hash, which can only add matches, never lose one."""
    t, out = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while m < n and tail < MISS:
            m += 1
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _survives(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Sequential test of signature pairs (rows of a and b)."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, low in enumerate(least):
        if not len(alive):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= low]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(x or bytes(HASHES) for x in column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _tested(percent: int):
    @F.arrow_udf("boolean")
    def survives(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_survives(_matrix(a), _matrix(b), least_matches(percent)))
    return survives


def _exact(size: int, percent: int):
    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(shingle_sets(a, size), shingle_sets(b, size)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
        return pa.array(out, pa.bool_())
    return linked


def _tiles(percent: int):
    """Survivors among the pairs of a tile's members that lie in different
    components; rows arrive sorted by (key, ti, tj), one tile after the other.
    A pair that shares several keys is looked at under its first band only."""
    least, n_bands = least_matches(percent), banding(percent)[0]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(t):
        own = t["bands"] == t["key"][0]
        t = {c: v[own.any(axis=1)] for c, v in t.items()}  # an id with several texts has a row for each
        if not len(t["id"]):
            return np.zeros((2, 0), np.int64)
        band = int(own[own.any(axis=1)][0].argmax())
        ids, comp, block, bands, sig = t["id"], t["component"], t["block"], t["bands"], t["sig"]
        left, right = np.flatnonzero(block == t["ti"][0]), np.flatnonzero(block == t["tj"][0])
        found = []
        for i in left:
            other = right[right > i] if t["ti"][0] == t["tj"][0] else right
            other = other[comp[other] != comp[i]]
            if band and len(other):
                other = other[~(bands[other, :band] == bands[i, :band]).any(axis=1)]
            if len(other):
                ok = other[_survives(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], least)]
                found.append(np.stack([np.full(len(ok), ids[i]), ids[ok]]))
        return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)

    def columns(batch):
        out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ti", "tj", "id", "component", "block")}
        bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(-1, n_bands)
        return out | {"sig": _matrix(batch.column("sig")), "bands": bands}

    def run(batches):
        held = None
        for batch in batches:
            t = columns(batch)
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            n = len(t["id"])
            if not n:
                continue
            change = np.flatnonzero((t["key"][1:] != t["key"][:-1]) | (t["ti"][1:] != t["ti"][:-1])
                                    | (t["tj"][1:] != t["tj"][:-1])) + 1
            edges = np.concatenate([[0], change])
            out = [pairs({c: v[lo:hi] for c, v in t.items()}) for lo, hi in zip(edges[:-1], edges[1:])]
            held = {c: v[edges[-1]:] for c, v in t.items()}
            if out:
                p = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], schema=schema)
        if held is not None and len(held["id"]):
            p = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], schema=schema)

    return run


def _cross_pairs(rows: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs (a, b) of ids that share a key but no component.  A key
    with many ids is cut into blocks of about TILE, and each pair of blocks is
    one unit of work, so no task holds a whole hot key."""
    blocks = F.ceil(F.col("members") / TILE).cast("int")
    rows = rows.join(sigs, "id").select(
        "key", "id", "component", "sig", "bands", blocks.alias("blocks"),
        F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
                       "id", "component", "block", "sig", "bands")
    rows = rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")
    found = rows.mapInArrow(_tiles(percent), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id,
    text)``.  ``component_id`` is the smallest doc_id reachable over links."""
    signed = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                   .mapInArrow(_sign(shingle, percent), "doc_id long, n long, s1 long, s2 long, bands array<long>"),
                   "signed")
    full = signed.where("n > 0 and doc_id is not null")
    # equal sets have equal bands: one row stands for all copies
    same = stage(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "sets")
    buckets = same.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    shared = stage(C.shared_buckets(buckets), "buckets")
    ids = stage(shared.select("id").distinct(), "candidates")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # one row an id, also where an id came with several texts
    texts = stage(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
                  .where("text is not null").join(ids, "id").dropDuplicates(["id", "text"]), "texts")
    sigs = stage(texts.mapInArrow(_signatures(shingle, percent), "id long, sig binary, bands binary"), "signatures")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return (pairs.join(ta, "a").join(tb, "b").where(_exact(shingle, percent)(F.col("ta"), F.col("tb")))
                .select("a", "b").distinct())

    def likely(pairs: DataFrame) -> DataFrame:
        sa = sigs.select(F.col("id").alias("a"), F.col("sig").alias("ga"))
        sb = sigs.select(F.col("id").alias("b"), F.col("sig").alias("gb"))
        return (pairs.join(sa, "a").join(sb, "b").where(_tested(percent)(F.col("ga"), F.col("gb")))
                .select("a", "b").distinct())

    # large groups collapse on a few hubs first, so few pairs of different components are left to compare
    links = stage(confirmed(likely(C.star_pairs(shared))), "links")
    label = C.components(links)
    still = stage(C.open_buckets(shared, label), "open")
    links = stage(links.union(confirmed(likely(C.bridge_pairs(still)))), "links")
    label = C.components(links)
    links = links.union(confirmed(_cross_pairs(C.open_buckets(still.select("key", "id"), label), sigs, percent)))
    # documents that share an id are one vertex, so the sets an id holds are linked through it
    several = full.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi")
    repeated = (full.join(several, "doc_id", "left_semi").select("doc_id", "s1", "s2", "n").distinct()
                .join(same, ["s1", "s2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    label = C.components(links.union(repeated))
    of_set = same.select("s1", "s2", "n", "rep")
    named = (signed.select("doc_id", "n", "s1", "s2").join(of_set, ["s1", "s2", "n"], "left")
             .join(label.withColumnRenamed("id", "rep"), "rep", "left"))
    return named.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
                        .alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that a link connects with a smaller
    doc_id, and with rows of equal doc_id and text once; all columns pass."""
    found = stage(near_duplicates(docs, shingle, percent), "found")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    again = stage(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "repeated")
    if again.isEmpty():
        return kept
    once = F.col("doc_id").cast("long").eqNullSafe(F.col("__again"))
    return kept.join(again, once, "left_anti").union(kept.join(again, once, "left_semi").dropDuplicates(["doc_id", "text"]))

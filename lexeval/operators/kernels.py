"""Arrow-batched per-row kernels for the parts of the metrics that are
sequence work inside one example (n-gram multiset clipping, longest common
subsequence, edit distance with block shifts, alignment chunks).

Tokenisation happens before, in JVM expressions; aggregation (best reference,
corpus sums, means) happens after, in Spark aggregates.  The kernels only see
the token arrays of one row at a time, carry no state between rows, and need
no shuffle: they run in whatever partitioning the aligned rows already have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexeval.operators.stem import stems


# ----------------------------------------------------------------- n-grams of a batch
# All texts of an Arrow batch are counted together: tokens (or characters) get
# dense ids, an n-gram of ids is packed into one integer beside its text's
# number, and one sort per order counts every n-gram of every text.  This is
# exact: ids are made dense again where packing would not fit, nothing is hashed.

#: Tokens or characters that are counted at once.
BATCH_TOKENS = 1 << 20


class _Texts:
    """Texts of a batch as one array of dense token ids with text bounds."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.v = int(ids.max()) + 1 if len(ids) else 1
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))  # tokens to the text's end
        self.grams, self.span = ids.astype(np.int64), self.v
        self.n = 1

    @staticmethod
    def of_tokens(lists) -> _Texts:
        sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        flat = np.concatenate([np.asarray(x, object) for x in lists]) if sizes.sum() else np.zeros(0, object)
        return _Texts(pd.factorize(flat)[0] if len(flat) else np.zeros(0, np.int64), sizes)

    @staticmethod
    def of_chars(texts) -> _Texts:
        sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int64)
        table[code] = 1
        return _Texts((np.cumsum(table) - 1)[code], sizes)

    def next_order(self) -> None:
        """From n-grams to (n + 1)-grams, by their first token's place."""
        if self.span * self.v * (len(self.sizes) + 1) >= 1 << 62:
            kept, inverse = np.unique(self.grams, return_inverse=True)
            self.grams, self.span = inverse, len(kept) + 1
        after = np.zeros_like(self.grams)
        after[:-self.n] = self.ids[self.n:]
        self.grams = self.grams * self.v + after
        self.span *= self.v
        self.n += 1

    def counts(self, texts: slice):
        """(text, gram, count) of the n-grams of a range of texts, sorted."""
        lo, hi = np.searchsorted(self.text, [texts.start, texts.stop])
        part = slice(lo, hi)
        whole = self.left[part] >= self.n
        key = np.sort(self.text[part][whole] * self.span + self.grams[part][whole])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        return key[first] // self.span, key[first] % self.span, count


def _chunks(sizes):
    """Row ranges of about BATCH_TOKENS tokens."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= BATCH_TOKENS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def _looked_up(keys, counts, wanted):
    """Counts of the wanted keys in sorted unique keys, 0 where missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def _clipped_per_ref(texts: _Texts, rows: int, owner: np.ndarray, max_order: int) -> list[np.ndarray]:
    """For each order the clipped matches of every reference with its row's
    hypothesis; texts are the hypotheses, then the references."""
    out = []
    for n in range(1, max_order + 1):
        if n > 1:
            texts.next_order()
        ht, hg, hc = texts.counts(slice(0, rows))
        rt, rg, rc = texts.counts(slice(rows, rows + len(owner)))
        m = np.minimum(_looked_up(ht * texts.span + hg, hc, owner[rt - rows] * texts.span + rg), rc)
        out.append(np.bincount(rt - rows, weights=m, minlength=len(owner)).astype(np.int64))
    return out


def _clipped_by_best(texts: _Texts, rows: int, owner: np.ndarray, max_order: int) -> list[np.ndarray]:
    """For each order the matches of every hypothesis, its n-gram counts clipped
    by the largest count in any one reference of its row."""
    out = []
    for n in range(1, max_order + 1):
        if n > 1:
            texts.next_order()
        ht, hg, hc = texts.counts(slice(0, rows))
        rt, rg, rc = texts.counts(slice(rows, rows + len(owner)))
        key = owner[rt - rows] * texts.span + rg
        order = np.lexsort((rc, key))
        key, rc = key[order], rc[order]
        last = np.concatenate([key[1:] != key[:-1], [True]]) if len(key) else np.zeros(0, bool)
        m = np.minimum(_looked_up(key[last], rc[last], ht * texts.span + hg), hc)
        out.append(np.bincount(ht, weights=m, minlength=rows).astype(np.int64))
    return out


def bleu_batch(hyps, refs, max_order: int = 4):
    """Per row (hyp_len, closest ref_len, clipped matches per order)."""
    out = []
    for lo, hi in _chunks([len(h) + sum(map(len, r)) for h, r in zip(hyps, refs)]):
        h, r = hyps[lo:hi], refs[lo:hi]
        owner = np.repeat(np.arange(hi - lo), [len(x) for x in r])
        texts = _Texts.of_tokens([*h, *(t for x in r for t in x)])
        matches = np.stack(_clipped_by_best(texts, hi - lo, owner, max_order), axis=1).tolist()
        for i in range(hi - lo):
            n = len(h[i])
            out.append((n, min(((abs(len(t) - n), len(t)) for t in r[i]), default=(0, 0))[1], matches[i]))
    return out


def chrf_batch(hyp_chars, hyp_words, ref_chars, ref_words, char_order: int = 6, word_order: int = 2):
    """Per row and reference the flat list ``[h, r, m] * orders`` (hypothesis
    n-grams, reference n-grams, clipped matches of each order)."""
    out = []
    for lo, hi in _chunks([len(h) + sum(map(len, r)) for h, r in zip(hyp_chars, ref_chars)]):
        rows, refs = hi - lo, [len(x) for x in ref_chars[lo:hi]]
        owner = np.repeat(np.arange(rows), refs)
        stats = []
        for texts, orders in ((_Texts.of_chars([*hyp_chars[lo:hi], *(t for x in ref_chars[lo:hi] for t in x)]), char_order),
                              (_Texts.of_tokens([*hyp_words[lo:hi], *(t for x in ref_words[lo:hi] for t in x)]), word_order)):
            size = texts.sizes
            for n, m in enumerate(_clipped_per_ref(texts, rows, owner, orders)):
                stats += [np.maximum(size[owner] - n, 0), np.maximum(size[rows:] - n, 0), m]
        flat, at = np.stack(stats, axis=1).tolist(), 0
        for n in refs:
            out.append(flat[at:at + n])
            at += n
    return out


# ----------------------------------------------------------------- BLEU
BLEU_STATS = T.StructType([
    T.StructField("hyp_len", T.LongType()),
    T.StructField("ref_len", T.LongType()),
    T.StructField("matches", T.ArrayType(T.LongType())),
])


@F.pandas_udf(BLEU_STATS)
def bleu_stats_udf(hyp: pd.Series, refs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(bleu_batch(hyp.tolist(), refs.tolist()), columns=["hyp_len", "ref_len", "matches"])


# ----------------------------------------------------------------- chrF
def chrf_stats_udf(char_order: int = 6, word_order: int = 2):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def run(hc: pd.Series, hw: pd.Series, rc: pd.Series, rw: pd.Series) -> pd.Series:
        return pd.Series(chrf_batch(hc.tolist(), hw.tolist(), rc.tolist(), rw.tolist(), char_order, word_order))
    return run


# ----------------------------------------------------------------- LCS
def lcs_len(a, b) -> int:
    """Length of the longest common subsequence (bit-parallel, Allison–Dix /
    Hyyrö: one big-integer step per token of ``b``)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(T.ArrayType(T.LongType()))
def lcs_udf(hyp: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([[lcs_len(list(r), list(h)) for r in rs] for h, rs in zip(hyp, refs)])


# ----------------------------------------------------------------- edit distance / TER
def edit_distance(a, b) -> int:
    """Word-level Levenshtein distance with unit costs (bit-parallel, Myers /
    Hyyrö: one big-integer step per token of ``b``)."""
    m = len(a)
    if m == 0:
        return len(b)
    if len(b) == 0:
        return m
    peq: dict = {}
    for i, t in enumerate(a):
        peq[t] = peq.get(t, 0) | (1 << i)
    mask = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for t in b:
        eq = peq.get(t, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & mask) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return score


class _Columns:
    """Edit-distance columns of a growing hypothesis against a reference, as
    bit vectors (Myers / Hyyrö): bit ``j`` of ``pv`` and ``mv`` tells that the
    distance of the first ``j + 1`` reference words is one above or below that
    of the first ``j``."""

    def __init__(self, ref: list[int], words: int):
        self.masks = [0] * words + [0]  # the last stands for a word that the reference lacks
        for j, w in enumerate(ref):
            self.masks[w] |= 1 << j
        self.full, self.top, self.m = (1 << len(ref)) - 1, len(ref) - 1, len(ref)

    def run(self, h: list[int]):
        """Columns ``pv, mv``, distances of the whole reference, and the steps
        ``ph, mh`` that led to each column from the one before."""
        full, top, masks = self.full, self.top, self.masks
        pv, mv, score = full, 0, self.m
        pvs, mvs, scores, phs, mhs = [pv], [mv], [score], [0], [0]
        for w in h:
            eq = masks[w]
            xh = ((((eq & pv) + pv) & full) ^ pv) | eq
            ph, mh = mv | (full ^ (xh | pv)), pv & xh
            score += (ph >> top) - (mh >> top)
            phs.append(ph)
            mhs.append(mh)
            ph = ((ph << 1) | 1) & full
            xv = eq | mv
            pv, mv = ((mh << 1) & full) | (full ^ (xv | ph)), ph & xv
            pvs.append(pv)
            mvs.append(mv)
            scores.append(score)
        return pvs, mvs, scores, phs, mhs

    def distance(self, known, lo: int, moved: list[int], h: list[int], most: int) -> int:
        """The distance of ``h`` with the words from ``lo`` on replaced by
        ``moved``, from the columns of ``h``; any number above ``most`` where it
        is larger than that.  Once a column is that of ``h`` again, so are the
        steps that follow."""
        pvs, mvs, scores = known[:3]
        full, top, masks = self.full, self.top, self.masks
        pv, mv, score, at = pvs[lo], mvs[lo], scores[lo], lo
        hi, n = lo + len(moved), len(h)
        for w in moved:
            eq = masks[w]
            xh = ((((eq & pv) + pv) & full) ^ pv) | eq
            ph, mh = mv | (full ^ (xh | pv)), pv & xh
            score += (ph >> top) - (mh >> top)
            ph = ((ph << 1) | 1) & full
            xv = eq | mv
            pv, mv = ((mh << 1) & full) | (full ^ (xv | ph)), ph & xv
        for at in range(hi, n):
            if score - (n - at) > most:
                return most + 1
            if pv == pvs[at] and mv == mvs[at]:
                return score + scores[n] - scores[at]
            eq = masks[h[at]]
            xh = ((((eq & pv) + pv) & full) ^ pv) | eq
            ph, mh = mv | (full ^ (xh | pv)), pv & xh
            score += (ph >> top) - (mh >> top)
            ph = ((ph << 1) | 1) & full
            xv = eq | mv
            pv, mv = ((mh << 1) & full) | (full ^ (xv | ph)), ph & xv
        return score


def _alignment(known, h, r):
    """Back-trace of the edit distance: (hyp_matched, ref_matched, ref_to_hyp),
    the last the hypothesis index at which a reference word is aligned or would
    be inserted."""
    pvs, mvs, _, phs, mhs = known
    i, j = len(h), len(r)
    hm, rm, r2h = [False] * i, [False] * j, [0] * j
    while i > 0 and j > 0:
        b = j - 1
        if h[i - 1] == r[b]:
            hm[i - 1] = rm[b] = True
            r2h[b] = i - 1
            i, j = i - 1, b
        elif (phs[i] >> b & 1) - (mhs[i] >> b & 1) + (pvs[i - 1] >> b & 1) - (mvs[i - 1] >> b & 1) == 1:
            r2h[b] = i - 1
            i, j = i - 1, b
        elif pvs[i] >> b & 1:
            r2h[b] = i
            j = b
        else:
            i -= 1
    return hm, rm, r2h


MAX_SHIFT_SIZE = 10
MAX_SHIFT_DIST = 50


def ter_edits(hyp, ref, max_size: int = MAX_SHIFT_SIZE, max_dist: int = MAX_SHIFT_DIST) -> int:
    """Edits of the translation edit rate (Snover et al. 2006): repeatedly
    apply the block shift of the hypothesis that lowers the word edit distance
    the most, then count shifts + remaining edit distance.  Candidate shifts
    follow the published rules: the span (at most ``max_size`` words) starts at
    a hypothesis word not matched by the current alignment, equals the
    reference at a position whose first word is unmatched, and moves to the
    hypothesis index aligned with that reference position, at most ``max_dist``
    words away.  Ties: larger gain, then longer span, then earlier start, then
    earlier target.

    Moving ``n`` words takes ``n`` deletions and ``n`` insertions, so it lowers
    the distance by 2n at most and gains 2n - 1 at most: spans are tried longest
    first, and the search ends when the bound falls to the best gain.  A
    candidate shares its words before the moved part with the hypothesis, so its
    distance starts from the column there (:class:`_Columns`), and ends where the
    columns meet again or it can no longer beat the best."""
    ids: dict = {}
    r = [ids.setdefault(t, len(ids)) for t in ref]
    h = [ids.get(t, -1) for t in hyp]
    if not r:
        return len(h)
    m = len(r)
    columns = _Columns(r, len(ids))
    starts: dict = {}
    for j, w in enumerate(r):
        starts.setdefault(w, []).append(j)
    shifts = 0
    while True:
        known = columns.run(h)
        cur = known[2][-1]
        if cur == 0:
            break
        hm, rm, r2h = _alignment(known, h, r)
        spans: dict[int, list] = {}
        for s, w in enumerate(h):
            if hm[s]:
                continue
            for j in starts.get(w, ()):
                t = r2h[j]
                if rm[j] or abs(t - s) > max_dist:
                    continue
                n = 0
                while n < max_size and s + n < len(h) and j + n < m and h[s + n] == r[j + n]:
                    n += 1
                    if not s <= t <= s + n:
                        spans.setdefault(n, []).append((s, t))
        best, tried = None, set()
        for n in sorted(spans, reverse=True):
            if best is not None and 2 * n - 1 <= best[0]:
                break
            for s, t in sorted(set(spans[n])):
                if best is not None and best[:2] == (2 * n - 1, n):
                    break  # as good as this length gets, and the earliest
                lo, hi = min(s, t), max(s + n, t)
                if (lo, hi, n, t > s) in tried:
                    continue
                tried.add((lo, hi, n, t > s))
                moved = h[s + n:t] + h[s:s + n] if t > s else h[s:s + n] + h[t:s]
                # longer spans and earlier places came first: only a larger gain is better
                most = cur - 2 - (best[0] if best is not None else 0)
                d = columns.distance(known, lo, moved, h, most)
                if d <= most:
                    best = (cur - d - 1, n, h[:lo] + moved + h[hi:])
        if best is None:
            break
        h = best[2]
        shifts += 1
    return shifts + cur


EDIT_STATS = T.StructType([
    T.StructField("edits", T.ArrayType(T.LongType())),
    T.StructField("ref_lens", T.ArrayType(T.LongType())),
])


@F.pandas_udf(T.ArrayType(T.LongType()))
def ter_udf(hyp: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([[ter_edits(h, r) for r in rs] for h, rs in zip(hyp, refs)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def word_edit_udf(hyp: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([[edit_distance(list(h), list(r)) for r in rs] for h, rs in zip(hyp, refs)])


# ----------------------------------------------------------------- METEOR
def _match_stage(h_keys, r_keys, h_used, r_used, pairs):
    """Scanning the hypothesis from its end, each unused word takes the last
    unused reference word with the same key (None never matches)."""
    positions: dict = {}
    for j, k in enumerate(r_keys):
        if not r_used[j] and k is not None:
            positions.setdefault(k, []).append(j)
    for i in range(len(h_keys) - 1, -1, -1):
        if h_used[i] or h_keys[i] is None:
            continue
        p = positions.get(h_keys[i])
        if p:
            j = p.pop()
            h_used[i] = r_used[j] = True
            pairs.append((i, j))


def meteor_row(hyp, ref, alpha=0.9, beta=3.0, gamma=0.5, hyp_cls=None, ref_cls=None) -> float:
    """METEOR of one hypothesis against one reference.  Stage 1 aligns equal
    words; an optional stage 2 aligns the remaining words whose classes (stems,
    synonym sets — any user table) are equal.  Chunks = maximal runs adjacent
    in both; score = (1 − γ·(chunks/matches)^β) · P·R / (α·P + (1 − α)·R)."""
    hyp = list(hyp)
    ref = list(ref)
    h_used, r_used = [False] * len(hyp), [False] * len(ref)
    pairs: list = []
    _match_stage(hyp, ref, h_used, r_used, pairs)
    if hyp_cls is not None and ref_cls is not None:
        _match_stage(list(hyp_cls), list(ref_cls), h_used, r_used, pairs)
    m = len(pairs)
    if m == 0:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(1 for a, b in zip(pairs, pairs[1:]) if not (b[0] == a[0] + 1 and b[1] == a[1] + 1))
    p = m / len(hyp)
    r = m / len(ref)
    fmean = p * r / (alpha * p + (1 - alpha) * r)
    return (1 - gamma * (chunks / m) ** beta) * fmean


def meteor_rows(hyp, refs, alpha=0.9, beta=3.0, gamma=0.5, stem=False) -> list[float]:
    """METEOR of one hypothesis against each reference; with ``stem`` the second
    stage aligns words of equal English stems."""
    own = stems(hyp) if stem else None
    return [meteor_row(hyp, r, alpha, beta, gamma, own, stems(r) if stem else None) for r in refs]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def meteor_udf(hyp: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([meteor_rows(h, rs) for h, rs in zip(hyp, refs)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def meteor_stem_udf(hyp: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([meteor_rows(h, rs, stem=True) for h, rs in zip(hyp, refs)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def meteor_found_udf(found: pd.Series, n_refs: pd.Series) -> pd.Series:
    """METEOR with classes from looked-up items: array 0 is the prediction,
    array k + 1 reference k; ``t`` the words, ``v`` their classes."""
    out = []
    for rows, n in zip(found, n_refs):
        texts = [([], []) for _ in range(n + 1)]
        for x in rows:
            texts[x["c"]][0].append(x["t"])
            texts[x["c"]][1].append(x["v"])
        out.append([meteor_row(texts[0][0], w, hyp_cls=texts[0][1], ref_cls=c) for w, c in texts[1:]])
    return pd.Series(out)

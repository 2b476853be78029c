"""Line dedup against brute force over all pairs of distinct lines."""

import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexeval.llm import linecodes
from lexeval.llm import linededup as L
from lexeval.llm.queries import QUERIES


def norm(line):
    return " ".join(w for w in re.split(L._PUNCTUATION, line.lower()) if w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def near(a, b):
    return distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def brute(docs):
    """docs: (doc_id, text) in order of rank."""
    first = {}
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if norm(line):
                first.setdefault(norm(line), (d, i))
    lines = list(first)
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if near(a.split(), b.split()):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y, key=first.get)] = min(x, y, key=first.get)
    return {(d, i): first[find(norm(line))] for d, text in docs for i, line in enumerate((text or "").split("\n")) if norm(line)}


def fixture():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    base = [[word() for _ in range(rng.choice([1, 3, 30, 60, 200]))] for _ in range(25)]

    def line():
        w = list(rng.choice(base)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = word()
        text = " ".join(w)
        return rng.choice([text, text.upper(), text + "!", "  " + text.replace(" ", ", ")])

    docs = [(0, None), (1, ""), (2, "\n\n ... \n"), (3, "Same\nsame\n\nSAME!")]
    return docs + [(i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in range(4, 130)]


def test_against_brute_force(spark):
    docs = fixture()
    group = brute(docs)
    want = {k: v for k, v in group.items() if k != v}
    assert any(norm(dict(docs)[a[0]].split("\n")[a[1]]) != norm(dict(docs)[b[0]].split("\n")[b[1]]) for a, b in want.items())
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, doc int").repartition(6)
    got = {(r.doc_id, x.line): (x.keeper_doc, x.keeper_line) for r in L.dropped_lines(df).collect() for x in r.dropped}
    assert got == want
    texts = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    for d, t in docs:
        kept = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in want]
        if len(kept) == len((t or "").split("\n")):
            assert texts[d] == t
        elif any(norm(x) for x in kept):
            assert texts[d] == "\n".join(kept)
        else:
            assert d not in texts


def test_similarity_of_long_lines_is_exact():
    rng = random.Random(5)
    pairs = []
    for n in (513, 700, 900):
        w = ["w%d" % rng.randrange(50) for _ in range(n)]
        for changes in (0, 1, n // 10, n // 5, n // 5 + 1, n // 4):
            v = list(w)
            for i in rng.sample(range(n), changes):
                v[i] = "x"
            pairs += [(w, v), (w, v[changes:]), (w[:-1], v[1:]), (w, v[n // 2:] + v[:n // 2])]
    code = lambda w: struct.pack(f">{len(w)}H", *[256 + zlib.crc32(x.encode()) % 55_000 for x in w])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int64()), pa.array([0] * len(pairs), pa.int64()),
                                        pa.array([code(a) for a, _ in pairs], pa.binary()), pa.array([code(b) for _, b in pairs], pa.binary())], ["a", "b", "ca", "cb"])
    got = {i for out in linecodes.similar_pairs(0.8)([batch]) for i in out.column(0).to_pylist()}
    assert got == {i for i, (a, b) in enumerate(pairs) if near(a, b)}


def test_bounds_of_the_distance():
    rng = random.Random(6)
    for n in (1, 5, 20, 80, 300):
        for k in (0, 1, n // 5):
            a = ["w%d" % rng.randrange(99) for _ in range(n)]
            b = changed(rng, a, k) or ["w1"]
            codes = [np.array([256 + int(w[1:]) if w[0] == "w" else 400 + int(w[3:]) % 50_000 for w in x], np.uint64) for x in (a, [w if w[0] == "w" else "new" + w[3:] for w in b])]
            x, y = (linecodes.parities(c * np.uint64(linecodes._ODD[0]), np.array([0])) for c in codes)
            d = distance(codes[0].tolist(), codes[1].tolist())
            assert sum(bin(int(u[0] ^ v[0])).count("1") for u, v in zip(x, y)) <= 2 * d
            bag = linecodes.bag_distances(codes[0], np.array([0, len(a)]), codes[1], np.array([0, len(codes[1])]))
            assert bag[0] <= d


@pytest.mark.parametrize("n", [1, 2, 127, 1000, 32001, 700_000])
def test_simhash_is_the_majority_of_the_word_hashes(n):
    rng = np.random.default_rng(n)
    hashes = rng.integers(0, 1 << 63, n + 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got = linecodes.simhash(hashes, np.array([0, n]), np.array([n, 5]))
    for value, own in zip(got, (hashes[:n], hashes[n:])):
        ones = [b for b in range(64) if int(((own >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(own)]
        assert int(value) == sum(1 << b for b in ones)


def test_rarest_pairs_against_sorting(spark):
    rng = random.Random(3)
    lines = [[rng.randrange(256, 300) for _ in range(rng.choice([1, 3, 4, 5, 9, 40]))] for _ in range(200)]
    classes = np.zeros(linecodes.TABLE, np.uint64)
    classes[256:300] = [rng.randrange(1, 9) for _ in range(44)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([struct.pack(f">{len(x)}H", *x) for x in lines], pa.binary())], ["id", "code"])
    got = {}
    for out in linecodes.rarest_pairs(classes, 0.8)([batch]):
        for key, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            got.setdefault(i >> 1, [[], i & 1])[0].append(key)
    for i, x in enumerate(lines):
        need = 2 + 2 * ((len(x) + 1) // 5)
        keys = sorted({(int(classes[a] + classes[b]) << 32) + (a << 16) + b for a, b in zip(x, x[1:])})
        assert got.get(i) == ([keys[:need], int(len(keys) < need)] if len(x) >= 4 else None)


def test_repeated_rows_shared_ids_and_empty_table(spark):
    rows = [(1, "alpha beta\ngamma"), (1, "alpha beta\ngamma"), (1, "gamma\ndelta"), (None, "delta"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in L.dedup_lines(df).collect()), key=repr)
    kept = [x for _, t in out for x in (t or "").split("\n")]
    assert kept.count("gamma") in (1, 2) and kept.count("delta") == 1 and (None, "delta") in out and (None, None) in out
    assert out.count((1, "alpha beta\ngamma")) + out.count((1, "alpha beta")) == 2
    assert L.dedup_lines(df.limit(0)).collect() == [] and L.dropped_lines(df.limit(0)).collect() == []


def test_very_long_lines_and_texts(spark):
    rng = random.Random(3)
    w = ["w%d" % rng.randrange(10 ** 6) for _ in range(20000)]
    v = list(w)
    v[7] = "other"
    docs = [(1, " ".join(w)), (2, " ".join(v)), (3, "\n".join(w))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in L.dropped_lines(df).collect()}
    assert (got[1].n_dropped, got[2].n_dropped, got[3].n_lines) == (0, 1, 20000)
    assert got[3].n_dropped == 20000 - len(set(w))


def test_query_on_the_given_documents(spark):
    rows = QUERIES["op2_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert len(rows) == len(docs)
    dropped = {(r.doc_id, x.line) for r in rows for x in r.dropped}
    seen = set()
    for d, t in sorted(docs):
        for i, line in enumerate(t.split("\n")):
            if norm(line) in seen:  # every exact copy goes
                assert (d, i) in dropped
            seen.add(norm(line))


def changed(rng, words, n):
    """``words`` after ``n`` random replacements, insertions and deletions."""
    out = list(words)
    for k in range(n):
        at = rng.randrange(len(out))
        out[at:at + rng.choice([0, 1, 1])] = ["new%d" % rng.randrange(10 ** 9)] if rng.random() < 0.7 else []
    return out


def test_every_pair_at_the_stated_similarity_is_found(spark):
    rng, pairs = random.Random(8), []
    for n in [*range(4, 26), 30, 40, 60, 100, 255, 256, 300]:
        for _ in range(4):
            a = ["w%d" % rng.randrange(10 ** 9) for _ in range(n)]
            evenly = list(a)  # the farthest apart: the unchanged runs are as short as they can be
            for i in range(4, n, 5):
                evenly[i] = "x%d" % rng.randrange(10 ** 9)
            pairs += [(a, evenly), ([w + "y" for w in a], changed(rng, [w + "y" for w in a], n // 5))]
    docs = [(2 * i + j, " ".join(w)) for i, p in enumerate(pairs) for j, w in enumerate(p)]
    got = {r.doc_id: r.dropped for r in L.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = [(0, 2 * i, 0)] if near(a, b) else []
        # the two pairs of one line are unrelated: their words differ
        assert [tuple(x) for x in got[2 * i + 1]] == want, (len(a), len(b))
    assert sum(near(a, b) for a, b in pairs) > 150


def staged_rows(spark, monkeypatch, docs, name):
    """Rows of the staged table ``name`` while the lines of ``docs`` are grouped, and the dropped lines."""
    rows, old = [], L.stage
    monkeypatch.setattr(L, "stage", lambda df, n: (out := old(df, n), n == name and rows.append(out.count()))[0])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    dropped = {(r.doc_id, x.line) for r in L.dropped_lines(df).collect() for x in r.dropped}
    return sum(rows), dropped


def test_a_common_passage_makes_no_keys(spark, monkeypatch):
    rng = random.Random(21)
    passage = " ".join("rare%d" % i for i in range(12))
    often = ["often%d" % i for i in range(700)]
    docs = [passage + " " + " ".join(rng.sample(often, 28)) for _ in range(300)]
    docs += [" ".join(rng.sample(often, 30)) for _ in range(300)] + [docs[7] + " one", docs[9].replace("rare3", "other")]
    rows, dropped = staged_rows(spark, monkeypatch, docs, "keys")
    assert dropped == {(600, 0), (601, 0)}
    assert rows < 1500  # each of the 300 lines had ten keys of the passage: over 3,000


def test_keys_of_lines_that_differ_too_much_in_length_are_not_paired(spark, monkeypatch):
    head = "shared one two three"
    word = iter("w%d" % i for i in range(10 ** 6))
    docs = [head + " " + " ".join(next(word) for _ in range(n)) for n in (6, 20, 60, 180)]
    docs += [docs[2] + " longer", " ".join(docs[3].split()[:-2])]
    rows, dropped = staged_rows(spark, monkeypatch, docs, "keys")
    assert dropped == {(4, 0), (5, 0)}
    keyed = spark.createDataFrame([(1, 10), (1, 24), (2, 10), (2, 12), (2, 24), (3, 40), (3, 50), (3, 51)], "key long, n int")
    assert sorted(map(tuple, L.fitting(keyed, 0.8).collect())) == [(2, 10), (2, 12), (3, 40), (3, 50), (3, 51)]


def test_similar_lines_share_as_many_numbered_pairs_as_promised(spark):
    rng, pairs = random.Random(31), []
    for n in [*range(5, 30), 60, 130, 300]:
        for often in (2, 4, 1000):  # few words that repeat, or none
            a = [rng.randrange(256, 256 + often) for _ in range(n)]
            for k in {1, n // 10, n // 5}:
                b = [x if isinstance(x, int) else 2000 + int(x[3:]) % 50_000 for x in changed(rng, a, k)]
                most = int(0.2 * max(len(a), len(b)) + 1e-9)
                if a != b and distance(a, b) <= most:
                    pairs.append((a, b))
    assert len(pairs) > 100
    lines = [x for pair in pairs for x in pair]
    classes = np.array([rng.randrange(1, 9) for _ in range(linecodes.TABLE)], np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array([struct.pack(f">{len(x)}H", *x) for x in lines], pa.binary())], ["id", "code"])
    got = {}
    for out in linecodes.rarest_pairs(classes, 0.8, None, linecodes.promised, numbered=True)([batch]):
        for key, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            assert key >= 0 and key not in got.setdefault(i >> 1, set())
            got[i >> 1].add(key)
    for i, (x, y) in enumerate(zip(lines[::2], lines[1::2])):
        least = spark.range(1).select(L.promised(F.lit(len(x)), F.lit(len(y)), 0.8)).first()[0] if i % 20 == 0 else min(
            max(linecodes.COMMON, min(len(x), len(y)) // linecodes.PER_COMMON), max(len(x), len(y)) - 1 - 2 * int(0.2 * max(len(x), len(y)) + 1e-9))
        assert 1 <= least <= len(got[2 * i] & got[2 * i + 1]), (len(x), len(y))


def test_lines_of_repeated_words_are_not_paired(spark, monkeypatch):
    docs = [" ".join(["word%d" % i] * (100 + i % 7)) + " more of it" for i in range(120)]
    rows, dropped = staged_rows(spark, monkeypatch, docs + [docs[5] + " today"], "pairs")
    assert dropped == {(120, 0)}
    assert rows < 2000  # all 7,140 pairs of them were compared: they share two keys, and their parity bits cancel out


def test_keys_are_made_and_shuffled_once(spark):
    keys = spark.createDataFrame([(1, 2, 10), (1, 4, 12), (2, 2, 10), (2, 6, 40), (3, 2, 10), (3, 4, 12), (3, 6, 40), (4, 8, 9)], "key long, id long, n int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = L.fitting(L.shared_keys(keys, 0.8), 0.8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") == 1 and plan.count("- Exchange hashpartitioning") == 1
        assert sorted((r.key, r.id, r.low, r.members) for r in found.collect()) == [(1, 2, 2, 2), (1, 4, 2, 2), (3, 2, 2, 3), (3, 4, 2, 3)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_lines_stay_staged_behind_the_groups(spark, monkeypatch):
    gone, old = [], L.discard
    monkeypatch.setattr(L, "discard", lambda staged: (gone.append(staged.columns), old(staged))[1])
    df = spark.createDataFrame([(1, "one two\nthree"), (2, "three\nfour five")], "doc_id long, text string")
    assert [(r.doc_id, r.n_dropped) for r in L.dropped_lines(df).orderBy("doc_id").collect()] == [(1, 0), (2, 1)]
    assert any("code" in c and "first" in c for c in gone)


def test_dealt_keys_give_the_pairs_that_share_them():
    rng = random.Random(17)
    rows = [(rng.randrange(-60, 60), rng.randrange(400), rng.choice([8, 10, 12, 20, 25])) for _ in range(600)]
    length = {i: n for _, i, n in rows}
    rows = sorted({(k, i, length[i]) for k, i, _ in rows})
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[lo:lo + 70]], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))],
                                          ["key", "id", "n"]) for lo in range(0, len(rows), 70)]
    fits = lambda x, y: abs(x - y) <= int(0.2 * max(x, y) + 1e-9)
    want = {}
    for k, a, n in rows:
        for j, b, m in rows:
            if k == j and a < b and fits(n, m):
                want[a, b] = want.get((a, b), 0) + 1
    dealt = [x for lo in range(0, len(batches), 4) for x in linecodes.dealt(linecodes.KEYS, 1, 3)(iter(batches[lo:lo + 4]))]
    of = lambda found, part: [b.filter(pa.array([p == part for p in b.column(0).to_pylist()])) for b in found]
    met = [x for part in range(3) for x in linecodes.paired(0.8, 5)(iter(of(dealt, part)))]
    assert of(met, -1) and not sum(b.num_rows for b in of(met, -1))  # no key is crowded
    got = {}
    for b in met:
        a, b, _ = linecodes._read([b], linecodes.MET)
        for pair in zip(a.tolist(), b.tolist()):
            got[pair] = got.get(pair, 0) + 1
    assert got == want and len(want) > 500
    least = {(a, b): int(linecodes.promises(np.array([length[a]]), np.array([length[b]]), 0.8)[0]) for a, b in want}
    found = [(a, b) for part in range(5) for x in linecodes.counted(iter(of(met, part))) for a, b in zip(*(c.to_pylist() for c in x.columns))]
    assert sorted(found) == sorted(pair for pair, n in want.items() if n >= least[pair])
    assert [x.num_rows for x in linecodes.counted(iter([]))] == [0] and list(linecodes.paired(0.8, 5)(iter([]))) == []


def test_crowded_and_very_frequent_keys_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(5)
    docs = []
    for k in range(12):  # lines around a passage, some of them similar
        passage = ["p%dw%d" % (k, i) for i in range(9)]
        docs += [" ".join(passage + rng.sample(["some%d" % i for i in range(40)], rng.randrange(3, 9))) for _ in range(30)]
    docs += [" ".join(changed(rng, d.split(), 1)) for d in docs[::7]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    found = lambda: {(r.doc_id, x.line, x.keeper_doc) for r in L.dropped_lines(df).collect() for x in r.dropped}
    want = {(d, i, to[0]) for (d, i), to in brute([(i, t) for i, t in enumerate(docs)]).items() if to != (d, i)}
    assert found() == want and len(want) > 40
    for name, value in (("GATHERED", 20), ("PART", 500), ("TURN", 100)):
        monkeypatch.setattr(L, name, value)
    assert found() == want


def test_keys_of_few_lines_are_not_staged_as_rows(spark, monkeypatch):
    rng = random.Random(9)
    docs = [" ".join("w%d" % rng.randrange(3000) for _ in range(30)) for _ in range(400)]
    docs += [" ".join(changed(rng, d.split(), 3)) for d in docs[:200]]
    rows, dropped = staged_rows(spark, monkeypatch, docs, "keys")
    assert rows == 0 and {(400 + i, 0) for i in range(200)} == dropped  # the rows of every shared key were

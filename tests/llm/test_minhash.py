"""Near-duplicate detection against a brute-force pair comparison."""

import random

from lexeval.llm.minhash import least_matches, near_duplicates


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def brute(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted(((d, len(x), None if d is None else find(d)) for d, x in sets), key=repr)


def fixture():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(60))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one"), (None, "one two"), (7, "Été é")]
    base = [[word() for _ in range(120)] for _ in range(12)]
    for i in range(300):  # copies of a few originals with growing numbers of changed words
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = word()
        rows.append((10 + i, " ".join(w)))
    rows += [(r[0], r[1]) for r in rows[20:30]]  # repeated rows
    rows.append((400, "x" * 3000 + " " + " ".join(word() for _ in range(30000))))
    rows.append((11, "one two"))  # an id with two texts links both groups
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(5)
    for size, percent in ((3, 85), (5, 80)):
        got = sorted((tuple(r) for r in near_duplicates(df, size, percent).collect()), key=repr)
        assert got == brute(rows, size, percent)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


def test_least_matches_keep_similar_pairs():
    low = least_matches(85)
    assert all(b > a for a, b in zip(low, low[1:])) and low[-1] < 0.85 * 512

import itertools
import random

import numpy as np

from skein.llm import fastsim


def brute(rows, k, percent):
    """{row number: (set size, smallest id reachable)} from all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        w = min(k, len(words))
        sets.append({tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(sets[i]), least.get(find(i))) for i in range(len(rows))]


def check(spark, rows, k=2, percent=80, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fastsim.near_duplicates(docs, k=k, percent=percent).collect()
    want = sorted(((d, n, c, d is not None and d == c) for (d, _), (n, c) in zip(rows, brute(rows, k, percent))), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == want


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out))


def test_against_brute_force(spark):
    check(spark, corpus())


def test_nulls_empty_short_ties_repeats(spark):
    rows = [(5, None), (6, ""), (7, "   \t"), (8, "One"), (9, "one"), (10, "two words"), (11, "TWO\nWORDS"), (12, "É x"), (13, "é x"), (4, "one"), (4, "one"), (None, "two words"), (3, "alone here now")]
    check(spark, rows)


def test_null_id_joins_two_others(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(["x", *words[1:]]), " ".join(["x", *words[1:-4], "y", "y2", "y3", "y4"])
    check(spark, [(1, a), (None, b), (2, c), (None, "alone here"), (None, "alone  here")])


def test_family_of_near_misses(spark):
    """Copies of one text with so many edits that most are not linked with it, some with each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(70)]
    out = [" ".join(base)]
    for n in range(160):
        copy = list(base)
        for at in rng.sample(range(70), rng.randint(1, 8)):
            copy[at] = f"e{rng.randint(0, 3)}{at}" if n % 3 else f"own{n}{at}"
        out.append(" ".join(copy[: rng.choice([70, 70, 62])]))
    check(spark, list(enumerate(out)))


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, node string, keys long")
    assert fastsim.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a b c", "y", 2)], "doc_id long, text string, node string, bucket long")
    assert {r.component_id for r in fastsim.near_duplicates(docs, k=2).collect()} == {1}


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    check(spark, [(1, long), (2, long + " tail"), (3, "short text here")])


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    for part in (1, 2, 7, 100, 800):
        assert not (fastsim.sketch(x[:part]) == np.uint64(2**64 - 1)).any()
    a, b = x[:800], x[100:900]
    same = (fastsim.sketch(a) == fastsim.sketch(b)).mean()
    assert abs(same - 700 / 900) < 0.12


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(bytes([100]), bytes([100 + i])) for i in range(1, 50)]
    got = {bytes(r.node): bytes(r.label) for r in fastsim.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(21)} | {bytes([100 + i]): bytes([100]) for i in range(50)}

import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import minhash
from corpusloom.llm.minhash import band_hashes, banding, differences, near_duplicates, signatures, sketches


def shingles(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[root(a)] = root(b)
    names = {}
    for k, (i, x) in enumerate(sets):
        if x and i is not None:
            names[root(k)] = min(i, names.get(root(k), i))
    return sorted(((i, len(x), names.get(root(k)) if x else i, not x or i == names.get(root(k))) for k, (i, x) in enumerate(sets)), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def corpus():
    """Families of copies of which some link only by way of others, and odd rows."""
    rng = random.Random(7)
    rows = []
    for family in range(4):
        base = [f"{family}w{rng.randrange(10_000)}" for _ in range(150)]
        for _ in range(60):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 0, 1, 2, 2, 3, 4, 6, 9]))))
        chain = list(base)
        for k in range(12):
            chain[11 * k] = f"c{k}{family}"
            rows.append((len(rows), " ".join(chain)))
    rows += [(500, ""), (501, None), (502, "  \n"), (503, "one two"), (504, "ONE\ttwo"), (505, "one two three"), (506, "long " * 30_000), (507, "long " * 40_000), (0, rows[0][1]), (508, rows[3][1].upper()), (None, rows[3][1]), (None, "nobody else says this at all")]
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, bands string").repartition(4)
    got = near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_difference_from_a_centre_that_one_of_them_misses():
    rng = np.random.default_rng(0)
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    tried = 0
    for _ in range(4_000):
        base = np.unique(rng.integers(0, 400, rng.integers(5, 60)).astype(np.uint64))

        def near():
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.1, 0.2])]
            return np.unique(np.append(keep, rng.integers(400, 420, rng.integers(0, 8)).astype(np.uint64)))

        x, y, z = near(), near(), near()
        if len(x) and len(y) and len(z) and linked(x, y) and not (linked(x, z) and linked(y, z)):
            tried += 1
            sides = [differences(v, z, 85) for v in (x, y)]
            sizes = [apart if linked or not other else near for (_, near, apart, linked), other in zip(sides, (sides[1][3], sides[0][3]))]
            order = rng.permutation(420)  # one for all sets
            p, q = (sorted(some.tolist(), key=order.__getitem__) for some, *_ in sides)
            first = next(v for v in p if v in q)
            at, to = p.index(first), q.index(first)
            assert at < sizes[0] and to < sizes[1]
            left = min(len(p) - at, len(q) - to)
            assert 370 * left >= 185 * (len(p) + len(q)) - 15 * (len(x) + len(y)), (x, y, z)
    assert tried > 100


def test_bands_follow_the_threshold():
    assert banding(85) == (27, 6)
    for t in (5, 30, 50, 70, 80, 90, 99):
        bands, rows = banding(t)
        assert (1 - (t / 100) ** rows) ** bands <= 3e-6
    rng = np.random.default_rng(1)
    for t, n in ((50, 60), (80, 20), (80, 90)):  # pairs of n shared shingles at the threshold exactly
        bands, rows = banding(t)
        own = n * (100 - t) // t // 2
        sets = [rng.integers(0, 1 << 63, n + 2 * own).astype(np.uint64) for _ in range(300)]
        x, y = ([np.unique(np.append(s[:n], s[n + k * own : n + (k + 1) * own])) for s in sets] for k in (0, 1))
        x, y = (band_hashes(sketches(v, bands * rows), bands) for v in (x, y))
        assert (x == y).any(1).all()


def test_components_at_other_thresholds(spark):
    rng = random.Random(11)
    rows = []
    for family in range(6):
        base = [f"{family}w{rng.randrange(10_000)}" for _ in range(150)]
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 1, 2, 4, 6, 9, 14]))) for k in range(25)]
    sets = [shingles(t) for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for t in (50, 80):
        name = list(range(len(rows)))
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                if name[a] != name[b] and 100 * len(x & y) >= t * len(x | y):
                    name = [min(name[a], name[b]) if n in (name[a], name[b]) else n for n in name]
        assert {r.doc_id: r.component_id for r in near_duplicates(df, t).collect()} == dict(enumerate(name))


def test_different_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=6))) for i in range(40)] + [(50 + i, "a b c d e f g") for i in range(3)]
    few = signatures(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("node", F.pmod("node", F.lit(7)))
    monkeypatch.setattr(minhash, "signatures", lambda docs, threshold: few)
    whole = minhash._sets
    monkeypatch.setattr(minhash, "_sets", lambda docs: whole(docs).withColumn("node", F.pmod("node", F.lit(7))))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows)

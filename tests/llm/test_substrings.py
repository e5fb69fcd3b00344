import random
import re

import numpy as np
import pytest

from corpusloom.llm import blocks
from corpusloom.llm.substrings import LENGTH, Runs, find_repeats
from corpusloom.llm.words import Words


def brute(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for a in range(len(w) - LENGTH + 1):
            run = tuple(w[a : a + LENGTH])
            first[run] = min(first.get(run, ((True, 1 << 62), 0)), (key(i), a))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - LENGTH + 1):
            if first[tuple(w[a : a + LENGTH])] < (key(i), a):
                gone[a : a + LENGTH] = [True] * LENGTH
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    prose = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    passages = [prose(n) for n in (19, 20, 21, 60)]
    rows = []
    for i in range(150):
        w = prose(rng.randrange(0, 80))
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(200, " ".join(passages[3] * 3)), (201, "la " * 5_000), (202, None), (203, ""), (204, " \n"), (3, rows[3][1]), (None, rows[4][1]), (205, "É" + " é" * 30), (206, " ".join(prose(30_000)))]
    return rows


@pytest.mark.parametrize("block", [2 << 20, 2_000])
def test_repeats_are_those_of_a_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    rows = corpus()
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], "doc_id long, text string, kept string, n_chars int").repartition(4)
    got = find_repeats(df).collect()
    assert all(r.n_chars == 5 and sum(s["end"] - s["start"] for s in r.repeats) == r.n_removed for r in got)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)


def test_no_rows(spark):
    assert find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_of_one_hash_that_differ_stay_apart():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        runs = Runs(rng.integers(0, 5, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint32), rng.integers(0, 6, n), rng.integers(0, 9, n).astype(np.int32))
        least = {}
        for h, c, q, a in zip(runs.h.tolist(), runs.check.tolist(), runs.seq.tolist(), runs.start.tolist()):
            least[h, c] = min(least.get((h, c), (9, 9)), (q, a))
        first = runs.first_places()
        assert {(h, c): (q, a) for h, c, q, a in zip(first.h.tolist(), first.check.tolist(), first.seq.tolist(), first.start.tolist())} == least and len(first.h) == len(least)
        later = [(q, a) > least[h, c] for h, c, q, a in zip(runs.h.tolist(), runs.check.tolist(), runs.seq.tolist(), runs.start.tolist())]
        assert runs.later_than(first).tolist() == later
        assert not runs.later_than(first[first.h > 9]).any()


def test_long_words_that_a_polynomial_takes_for_equal_have_other_hashes():
    flips = "a"
    while len(flips) < 1 << 13:
        flips += flips.translate({97: "b", 98: "a"})
    raw = f"{flips} {flips.translate({97: 'b', 98: 'a'})} {flips}".encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
    assert w.hash[0] == w.hash[2] != w.hash[1]


def test_buckets_have_a_most_and_ranges_have_none():
    from corpusloom.llm.blocks import MOST_BUCKETS, buckets_for

    assert buckets_for(1, 200) == 1 and buckets_for(100, 200) == 100 and buckets_for(10_000, 200) == 2_500
    assert buckets_for(500_000, 200) == buckets_for(50_000_000, 1_000) == MOST_BUCKETS < 100_000

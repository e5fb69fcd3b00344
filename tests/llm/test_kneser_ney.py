import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import pytest

from corpusloom.llm import kneser_ney
from corpusloom.llm.kneser_ney import discounts, score, train

ROWS = [
    (1, "the cat sat on the mat"),
    (2, "The CAT ran\tto the  mat"),
    (3, "a dog sat on a cat and a dog ran"),
    (4, ""),
    (5, None),
    (6, "the cat sat on the mat"),
    (7, "café É the  x y"),
    (None, "the cat unseen"),
    (8, "word " * 3_000),
    (8, "word " * 3_000),
]


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def brute(train_rows, rows):
    pairs = Counter(p for _, t in train_rows for p in zip(["<s>", *words(t)], words(t)))
    n = Counter(w for _, t in train_rows for w in words(t))
    total, distinct = sum(n.values()), len(n)
    preds, context, follow = Counter(), Counter(), {}
    for (v, w), c in pairs.items():
        preds[w] += 1
        context[v] += c
        follow.setdefault(v, Counter())[min(c, 3)] += 1
    cut = lambda counts: (0.0, *discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]))
    d2, d1 = cut(pairs), cut(preds)
    gamma1 = sum(d1[min(c, 3)] for c in preds.values()) / len(pairs) if pairs else 1.0

    def single(w):
        return (preds[w] - d1[min(preds[w], 3)]) / max(1, len(pairs)) + gamma1 / (distinct + 1)

    def p(v, w):
        if not context[v]:
            return single(w)
        gamma = sum(d2[k] * m for k, m in follow[v].items()) / context[v]
        return (pairs[v, w] - d2[min(pairs[v, w], 3)]) / context[v] + gamma * single(w)

    out = []
    for i, t in rows:
        tokens = words(t)
        base = sum(math.log10((n[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        out.append((i, len(tokens), sum(n[w] > 0 for w in tokens), total, base, sum(math.log10(p(v, w)) for v, w in zip(["<s>", *tokens], tokens))))
    for v in [*context, "never"]:  # a distribution: the vocabulary and one unknown word
        assert not pairs or sum(p(v, w) for w in [*n, "never"]) == pytest.approx(1)
    return out


@pytest.mark.parametrize("range_bytes", [1 << 20, 1_000])
def test_scores_are_those_of_a_plain_model(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", range_bytes)
    df = spark.createDataFrame([(*r, "x", 0.5) for r in ROWS], "doc_id long, text string, held_out string, score double").repartition(3)
    teach = [r for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10]
    got = score(df, train(df.where(~kneser_ney.held_out()))).collect()
    key = lambda r: tuple(map(str, r[:4]))
    want = sorted(brute(teach, ROWS), key=key)
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    for r, w in zip(rows, want):
        assert r[4:] == pytest.approx(w[4:])
    assert {r.doc_id for r in got if r.held_out} == {None, *(i for i, _ in ROWS if i and zlib.crc32(str(i).encode()) % 10 == 0)}


def test_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = train(df.limit(0))
    assert [(r.doc_id, r.score, r.n_known) for r in score(df, model).orderBy("doc_id").collect()] == [(1, 0.0, 0), (2, 0.0, 0)]
    assert score(df.limit(0), train(df)).count() == 0


def plain(teach, rows, order):
    """log10 probabilities by the definition, gram by gram."""
    marks = ["<s>"] * (order - 1)
    grams = {k: Counter() for k in range(1, order + 1)}
    for _, t in teach:
        w = [*marks, *words(t)]
        grams[order].update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    d = {k: (0.0, *discounts([sum(c == n for c in grams[k].values()) for n in (1, 2, 3, 4)])) for k in grams}
    total, lost = Counter(), Counter()
    for k in grams:
        for g, c in grams[k].items():
            total[k, g[:-1]] += c
            lost[k, g[:-1]] += d[k][min(c, 3)]

    def p(k, g):
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        lower = p(k - 1, g[1:])
        if not total[k, g[:-1]]:
            return lower
        c = grams[k][g]
        return (c - d[k][min(c, 3)] + lost[k, g[:-1]] * lower) / total[k, g[:-1]]

    out = []
    for i, t in rows:
        w = [*marks, *words(t)]
        out.append((str(i), str(t), sum(math.log10(p(order, tuple(w[n - order + 1 : n + 1]))) for n in range(order - 1, len(w)))))
    return sorted(out)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_every_order_counts_words_before(spark, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", 500)
    rng = random.Random(order)
    rows = ROWS + [(20 + i, " ".join(rng.choices("abcdefg", [9, 7, 5, 3, 2, 1, 1], k=rng.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = score(df, train(df.where("doc_id < 60"), order)).collect()
    want = plain([r for r in rows if r[0] is not None and r[0] < 60], rows, order)
    assert sorted(str(r.doc_id) for r in got) == [w[0] for w in want]
    by_id = {}
    for i, _, x in want:
        by_id.setdefault(i, []).append(x)
    for r in got:
        assert any(r.score == pytest.approx(x) for x in by_id[str(r.doc_id)])


def test_few_files_are_open_whatever_the_number_of_ranges(tmp_path):
    code = """
import resource, sys
import numpy as np
from corpusloom.llm import kneser_ney as k
k.OPEN = 16
store = k.Store(sys.argv[1], 5_000)
h = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 60_000, np.uint64))
for file, s in k.ranges(h, store.parts, store.file_of):
    w = k.Writer(store.path("t", file), {"hashes": np.uint64, "a": np.int64})
    for half in np.array_split(h[s], 2):
        w.append(hashes=half, a=(half % np.uint64(1_000)).astype(np.int64))
    w.close()
resource.setrlimit(resource.RLIMIT_NOFILE, (60, 60))
some = np.concatenate([h[::3], h[:50], h[::3] + np.uint64(1)])
assert store.files > 600
for _ in range(2):
    (a,) = k.look_up(store, "t", some, a=np.float64)
    assert (a == np.where(np.isin(some, h), some % np.uint64(1_000), 0)).all()
print(len(k._open))
"""
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True)
    assert out.stdout.strip() == "16", out.stderr

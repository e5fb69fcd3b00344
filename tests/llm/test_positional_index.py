import pickle
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import positional_index
from corpusloom.llm.positional_index import Phrases, find_phrases


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    phrases = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if n else ():
            phrases.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in phrases:
                    found |= phrases[tuple(w[a : a + n])]
                    hit.update(range(a, a + n))
        out.append((i, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("alpha beta gamma Delta éa xyz".split()) for _ in range(n))
    items = [(1, text(12)), (2, text(40)), (3, "Alpha, beta!"), (4, None), (5, "..."), (6, "xyz"), (None, text(10)), (1, text(11)), (7, "never seen before")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(200)]
    docs += [(300, items[1][1]), (301, f"x {items[0][1]} y {items[0][1]}"), (302, None), (303, ""), (None, items[0][1]), (300, items[1][1]), (304, "alpha beta " * 20_000)]
    return docs, items


@pytest.mark.parametrize("slice_bytes", [8 << 20, 60])
@pytest.mark.parametrize("piece", [1 << 18, 3])
def test_hits_and_items_are_those_of_a_plain_scan(spark, monkeypatch, slice_bytes, piece):
    monkeypatch.setattr(positional_index, "PIECE", piece)
    docs, items = cases()
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, key int, items string").repartition(3)
    at = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_hit int")
    got = find_phrases(df, at, slice_bytes=slice_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert find_phrases(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.n_hit) for r in find_phrases(docs, items.limit(0)).collect()] == [(2, 0)]


def brute_near(docs, items, distance, window=10):
    """Per document the items with a window whose words all lie within distance of its rarest, the first of equally rare ones."""
    counts = Counter(x for _, t in docs for x in words(t))
    phrases = set()
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        phrases |= {(i, tuple(w[a : a + n])) for a in range(len(w) - n + 1)} if n and i is not None else set()
    out = []
    for i, t in docs:
        w, found = words(t), set()
        for item, p in phrases:
            rare = min(p, key=lambda x: counts[x])
            if any(x == rare and all(y in w[max(0, at - distance) : at + distance + 1] for y in p) for at, x in enumerate(w)):
                found.add(item)
        out.append((i, sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [8 << 20, 60])
def test_items_near_a_place_are_those_of_a_plain_search(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(positional_index, "PIECE", 50)
    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(14)]
    text = lambda n: " ".join(rng.choices(vocabulary, range(1, 15), k=n))
    items = [(i, text(rng.randint(1, 14))) for i in range(25)] + [(None, text(12))]
    docs = [(i, text(rng.randint(0, 80))) for i in range(150)] + [(150, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = find_phrases(df, spark.createDataFrame(items, "item_id long, text string"), slice_bytes=slice_bytes, distance=12).collect()
    assert sorted(((r.doc_id, list(r.near)) for r in got), key=str) == brute_near(docs, items, 12)
    assert any(set(r.near) - set(r["items"]) for r in got) and all(set(r["items"]) <= set(r.near) for r in got)


def test_phrases_of_a_large_slice_stay_flat():
    rng = np.random.default_rng(3)
    line = " ".join(f"w{n}" for n in rng.integers(0, 50_000, 3_000))
    items = pa.table({"item_id": pa.array(range(200), pa.int64()), "text": [line[k:] for k in range(200)]})
    tracemalloc.start()
    phrases = Phrases(items, 10)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    whole = [p for p in range(len(phrases.at)) if phrases.first[p + 1] - phrases.first[p] > 150]
    assert len(phrases.at) < 2 * 3_000 and len(whole) > 2_900
    assert len(pickle.dumps(phrases)) < 12 << 20

import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from corpusloom.llm import spelling, sql
from corpusloom.llm.spelling import group_spellings, keys_of

SCHEMA = "doc_id long, text string"


def words_of(docs):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = words_of(docs)
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, some in around.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n[w], len(around[w]), n.get(form[w])) for w in n}


def docs_of(letters="abé", seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 7))) for _ in range(300)]
    words += [w[:2] + "Z" + w[2:] for w in words[:60]] + ["straße", "strasse", "aaaaa", "aaaaaa", "aaaaaaa", "x×yz÷w", "ÄÖÜäö"]
    docs = [(i, " ".join(r.choices(words, k=80)).replace("z", "Z")) for i in range(100)]
    return docs + [(3, docs[3][1]), (None, "aaaaa aaaaaa"), (None, None), (7, None), (8, ""), (9, "1_2")]


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh"])
def test_groups_are_those_of_all_pairs(spark, letters):
    docs = docs_of(letters)
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 word", "2 n", "'x' key")
    assert {tuple(r) for r in group_spellings(df).collect()} == plain(docs)


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    docs = docs_of()
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    rows = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({sql.SPELLINGS})").fetchall()
    assert len(rows) == len(set(rows)) and set(rows) == plain(docs)


def test_long_words_meet_by_name(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MISSPELT", 1 << 40)
    base = "ab" * 31
    words = [base + x for x in ("", "a", "b", "ab", "abc", "abd", "xabd", "abdd", "q")] + ["z" * 5_000, "z" * 5_001, "z" * 2_500 + "y" + "z" * 2_499]
    docs = [(i, " ".join(w for n, w in enumerate(words) for _ in range(1 + n % 3 * 4))) for i in range(3)]
    n = {w: 3 * (1 + i % 3 * 4) for i, w in enumerate(words)}
    got = {r.word: r for r in group_spellings(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert {w: r.n for w, r in got.items()} == n
    for w in words:
        some = [v for v in words if near(w, v)]
        best = min(some, key=lambda v: (-n[v], v), default=None)
        assert got[w].n_near == len(some)
        assert got[w].form == (best if best and n[best] >= 2 * n[w] else None)


def test_words_of_one_key_are_compared_as_strings(spark, monkeypatch):
    """All hashes collide, and nothing changes."""
    monkeypatch.setattr(spelling, "mix", lambda h, *_: np.zeros_like(h))
    docs = docs_of("ab")[:30]
    words = words_of(docs)
    which, at, key = keys_of(sorted(words))
    assert not key.any()
    rows = sorted(words)
    met = [(rows[i], words[rows[i]], int(p)) for i, p in zip(which, at)]
    found = Counter()
    for word, n, _, _ in spelling.neighbours(met):
        found[word] += n
    assert found == Counter({w: n for w in words if (n := sum(near(w, v) for v in words))})


def test_keys_are_those_of_strings_without_a_character():
    words = ["abcde", "abxde", "abde", "éabcd", "abcd", "aab", "ab" * 40]
    which, at, key = keys_of(words)
    names = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(which, at)]
    by = {}
    for name, k in zip(names, key.tolist()):
        assert by.setdefault(name, k) == k
    assert len(set(by.values())) == len(by)


def test_empty(spark):
    assert group_spellings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert group_spellings(spark.createDataFrame([(1, "some words only once")], SCHEMA)).count() == 0

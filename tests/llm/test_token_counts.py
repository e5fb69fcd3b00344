import functools
import random
import unicodedata

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.token_counts import VOCABULARY, Automaton, Counter, count_tokens, read_pieces, symbols

PIECES = read_pieces(public_tokenizers.path(VOCABULARY))
AUTOMATON = Automaton(PIECES)


def greedy(word, pieces):
    n = at = 0
    longest = max(map(len, pieces))
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=40))
def test_count_is_that_of_greedy_longest_match(word):
    w = symbols(word.lower().encode("utf-8", "replace"), True)
    assert AUTOMATON.count(w) == greedy(w, PIECES)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.lists(st.integers(0, 2), min_size=1, max_size=5).map(tuple), max_size=12), st.lists(st.integers(0, 2), max_size=14).map(tuple))
def test_small_vocabularies_with_dead_ends(pieces, word):
    if pieces:
        assert Automaton(pieces).count(word) == greedy(word, pieces)


def test_rows(spark):
    rows = [(1, "hello hello"), (2, None), (3, ""), (4, "x" * 50_000), (1, "hello hello"), (None, "12")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_words", "2 as n_tokens")
    got = sorted(map(tuple, count_tokens(df).collect()), key=str)
    hello = greedy(symbols(b"hello", True), PIECES)
    many = greedy(symbols(b"x" * 50_000, True), PIECES)
    assert got == sorted([(1, 2, 2 * hello), (1, 2, 2 * hello), (2, 0, 0), (3, 0, 0), (4, 1, many), (None, 2, 2)], key=str)
    assert count_tokens(df.limit(0)).count() == 0


@functools.lru_cache(None)
def _greedy(word):
    return greedy(symbols(word.encode(), True), PIECES)


def plain(text):
    """Words and tokens of a text, character by character."""
    words, kind = [], None
    for c in (text or "").lower():
        k = "letter" if unicodedata.category(c)[0] == "L" else "digit" if unicodedata.category(c)[0] == "N" else None if c.isspace() and not 0x1C <= ord(c) <= 0x1F else "other"
        if k in ("letter", "other") and k == kind:
            words[-1] += c
        elif k:
            words.append(c)
        kind = k
    return len(words), sum(map(_greedy, words))


def test_whole_texts_are_split_and_counted_as_plainly(spark):
    rng = random.Random(4)
    parts = ["Hello", "ÉTÉ", "straße", "İ", "12345", "٣", "x1y", "!?", "…", "  ", "\t", "\n", "\u00a0", "\u3000", "漢字", "emoji🙂", "e\u0301", "w" * 40]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(300)]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_long_words_are_counted_and_not_kept():
    counter = Counter(AUTOMATON)
    long = [chr(97 + i % 26) * 3 + str(i) + "q" * 10_000 for i in range(50)]
    n, tokens = counter.count(" ".join(long))
    assert n == 190 and tokens == sum(plain(w)[1] for w in long[:2]) + sum(counter.count(w)[1] for w in long[2:])
    assert all(len(w) <= 32 for w in counter.kept)

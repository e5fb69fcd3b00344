"""Words that differ by one character, and for each word the commoner form that it may be a variant of.

Texts give words and counts, summed in tasks before they meet. A word gives one key for itself and one for each
character left out: the polynomial hash of what stands before it and of what stands after it, from running sums over all words
of a batch. Keys are dealt out by their first bits and sorted as integers; words that meet at a key are compared as strings.

Two words that differ by one replaced character meet where that character is left out of both, and nowhere else; one that is
longer by a character meets the shorter one itself. So nothing is listed twice, no pair is listed at all: each group gives every
member the number of its neighbours and the best of them, and at most as many words meet as there are letters and places.

Defined results: null and empty texts have no words; very long ones are counted whole; in the key of a row without doc_id nothing stands before the colon; repeated rows count each;
of neighbours with the same count the first in code-point order is the form; an empty table gives no rows; other columns are
ignored. Words of any length are compared: those of more than LONG characters meet by the name of their string, and the strings are
joined where two of them met.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.tables import in_batches, in_groups, partitions, read, stored
from corpusloom.llm.words import U64, _Powers, mix

RUN = "[a-zÀ-ÿ]+"
#: Code points and occurrences that a word must have.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many, by CRC-32, loses a character; a form has so many times the word's occurrences at least.
MISSPELT, TIMES = 97, 2
#: Characters from which a word doesn't travel with each of its keys.
LONG = 64
#: Words, and their characters, that a task counts before it hands them on.
COUNTED, CHARACTERS = 200_000, 4 << 20
#: Bits of a key by which it is dealt out.
RADIX = 12
_POWERS = _Powers(0x9E3779B97F4A7C15 & ~7 | 5)
_NEAR = "word string, near long, best_n long, best string, key long, at int, name string, n long"


def spelt(doc: bytes, run: str) -> str:
    """The run, or what is left of it without one character; doc is what stands before it in the key."""
    h = crc32(run.encode(), crc32(doc))
    return run if h % MISSPELT else run[: (k := h % len(run))] + run[k + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of all words of docs."""
    find = re.compile(RUN).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1).cast(pa.large_string()))):
                doc = f"{'' if doc_id is None else doc_id}:".encode()
                for w, n in Counter(find(text.as_py() or "")).items():
                    if len(w) >= LEAST_LENGTH and len(w := spelt(doc, w)) >= LEAST_LENGTH:
                        size += len(w) if w not in total else 0
                        total[w] += n
                if len(total) > COUNTED or size > CHARACTERS:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
                    total, size = Counter(), 0
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    counted = in_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key of some words: which word, the place left out (-1: none), and the hash of what is left."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = _POWERS.upto(len(points) + 2)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points) * up[: len(points)], out=total[1:])
    which = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(points))
    before = (total[at] - total[starts[which]]) * down[starts[which]]
    after = (total[ends[which]] - total[at + 1]) * down[starts[which] + 1]
    whole = (total[ends] - total[starts]) * down[starts]
    return np.concatenate([np.arange(len(words)), which]), np.concatenate([np.full(len(words), -1), at - starts[which]]), mix(np.concatenate([whole, before + after]))


def delete(words: DataFrame) -> DataFrame:
    """words (word, n, name) by their keys: key, at, word (null for a long one), name (of a long one), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            which, at, key = keys_of(texts)
            short = pa.array([None if len(w) > LONG else w for w in texts], pa.string())
            for a in range(0, len(key), 1 << 16):
                of = pa.array(which[a : a + (1 << 16)])
                rest = [c.take(of) for c in (short, batch.column(2), batch.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)].view(np.int64)), pa.array(at[a : a + (1 << 16)], pa.int32()), *rest], ["key", "at", "word", "name", "n"])

    return in_batches(words.select("word", "n", "name"), run, "key long, at int, word string, name string, n long")


def neighbours(met: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Of words that met at one key (word, n, place left out): each one's number of neighbours here, and the n and the word of the best."""
    by_rest = defaultdict(list)
    for word, n, at in met:
        by_rest[word if at < 0 else word[:at] + word[at + 1 :]].append((-n, word, at))
    for rows in by_rest.values():
        if len(rows) < 2:
            continue
        by_place = defaultdict(list)
        for n, word, at in rows:
            by_place[at].append((n, word))
        whole = by_place.pop(-1, None)
        for same in by_place.values():
            if len(same) > 1:
                best, second = sorted(same)[:2]
                for x in same:
                    n, word = second if x == best else best
                    yield x[1], len(same) - 1, -n, word
        if whole and by_place:
            [(n, word)] = whole
            longer = {x for same in by_place.values() for x in same}  # a doubled letter may be left out at two places
            for x in longer:
                yield x[1], 1, -n, word
            best = min(longer)
            yield word, len(longer), -best[0], best[1]


def _near(rows: list) -> pa.RecordBatch:
    fields = [f.split() for f in _NEAR.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _NEAR from rows of delete, sorted by key; where a long word met another, the members themselves."""
    left = None
    for batch in _with_end(batches):
        parts = [x for x in (left, batch) if x is not None and x.num_rows]
        if not parts:
            continue
        table = pa.Table.from_batches(parts)
        key = table.column("key").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        if batch is not None:  # the last key may go on
            left = table.slice(int(first[-1])).combine_chunks().to_batches()[0]
            key, first = key[: first[-1]], first[:-1]
        sizes = np.diff(np.append(first, len(key)))
        rows = table.take(np.flatnonzero(np.repeat(sizes > 1, sizes))).to_pylist()
        out = []
        for _, group in groupby(rows, lambda r: r["key"]):
            group = list(group)
            if all(r["word"] is not None for r in group):
                out.extend((*x, None, None, None, None) for x in neighbours([(r["word"], r["n"], r["at"]) for r in group]))
            else:
                out.extend((r["word"], None, None, None, r["key"], r["at"], r["name"], r["n"]) for r in group)
        if out:
            yield _near(out)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of each of words (word, n) that has a neighbour."""
    spark = words.sparkSession
    named = words.withColumn("name", F.when(F.length("word") > LONG, F.sha2("word", 256)))
    keys = delete(named).withColumn("radix", F.shiftrightunsigned("key", 64 - RADIX))
    dealt = keys.repartition(partitions(spark), "radix").sortWithinPartitions("key").drop("radix")
    met = stored(in_batches(dealt, meet, _NEAR), "near")
    columns = ["word", "near", "best_n", "best"]

    def judge(group: pa.Table) -> pa.Table:
        rows = [(*x, None, None, None, None) for x in neighbours([(r["word"], r["n"], r["at"]) for r in group.to_pylist()])]
        return pa.Table.from_batches([_near(rows) if rows else _near([(None,) * 8]).slice(1)])

    strings = named.where("name is not null").select("name", F.col("word").alias("string"))
    long = met.where("key is not null").join(strings, "name", "left").select("key", "at", "n", F.coalesce("word", "string").alias("word"))
    found = met.where("key is null").select(columns).union(in_groups(long.groupBy("key"), judge, _NEAR).select(columns))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form) end; each round doubles how far they reach."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def group_spellings(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text)."""
    words = stored(count_words(docs), "words")
    near = near_words(words)
    known = F.col("best_n") >= TIMES * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        F.when(known, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("best_n")).alias("form_n"),
    )
    found = stored(found, "forms")
    roots = follow(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read(spark, sf_dir, "documents"))

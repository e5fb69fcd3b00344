"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the token postings of all documents, once: a row for each segment of about a megabyte
of text, with its documents, its distinct terms, and the positions of each term. ``search`` looks
for test phrases: in each segment it takes the postings of a phrase's rarest term, by
counts over the whole index, shifts them to where the phrase would begin, and
intersects with the shifted postings of the next rarest term, until all terms agree. On its way it also finds the
items near a place: those with a window whose terms all lie within NEAR words of its rarest term.

Segments are independent, so a frequent word makes no task larger. Test items are few next to the
documents; they go to the workers in slices of at most SLICE_BYTES of text, as numbered terms in flat arrays of about
thrice that size, and each slice is one pass over the stored index.

Defined results: null and empty texts have no words and no hits; an item without words matches nothing;
an item without item_id hits words but is not listed; rows with one item_id are one item;
repeated documents are judged each; an empty table on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.blocks import numbers, planes
from corpusloom.llm.tables import in_batches, read, stored
from corpusloom.llm.words import ALNUM, Words, column, grams, texts_of

WINDOW, NEAR = 10, 20
#: Bytes of test text that are sent to the workers at once.
SLICE_BYTES = 4 << 20
#: Postings that are shifted and intersected at once.
PIECE = 1 << 18
_INDEX = "doc_ids array<long>, keys array<long>, counts array<int>, terms binary, ends binary, positions binary"


class Phrases:
    """The distinct windows of some items, with the items of each; terms are hashes, sorted."""

    def __init__(self, items: pa.Table, window: int):
        items = items.combine_chunks()
        batch = items.to_batches()[0] if items.num_rows else pa.RecordBatch.from_pylist([], items.schema)
        w = Words(*column(batch, "text"), ALNUM, fold=True)
        self.window = window
        self.terms, number = np.unique(w.hash, return_inverse=True)
        self.words = number.astype(np.int32)
        size = np.minimum(window, w.counts)
        n = np.where(size > 0, w.counts - size + 1, 0)
        item = np.repeat(np.arange(w.texts), n)
        at = w.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        # equal windows come together by a hash of their words; those that differ stay apart all the same
        size = size[item]
        by_size = {k: grams(w.hash, k, k) for k in np.unique(size).tolist()}
        h = np.zeros(len(at), np.uint64)
        for k, g in by_size.items():
            h[size == k] = g[at[size == k]]
        order = np.argsort(h, kind="stable")
        at, size, item = at[order], size[order], item[order]
        self.at, self.sizes = at.astype(np.int32), size.astype(np.int8)
        rows = self.rows()
        new = np.ones(len(at), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        phrase = np.cumsum(new) - 1
        self.at, self.sizes = self.at[new], self.sizes[new]
        ids = batch.column(batch.schema.get_field_index("item_id"))
        known = np.asarray(ids.is_valid())[item]
        pairs = np.unique(np.stack([phrase[known], np.asarray(ids.fill_null(0), np.int64)[item[known]]]), axis=1) if known.any() else np.zeros((2, 0), np.int64)
        #: Ids of the items of each phrase: those of phrase p are items[first[p] : first[p + 1]].
        self.items, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.at) + 1))
        self.counts = np.zeros(len(self.terms), np.int64)

    def rows(self) -> np.ndarray:
        """(phrases, window): numbers of the terms, -1 behind the last."""
        offset = np.arange(self.window)
        inside = offset < self.sizes[:, None]
        return np.where(inside, np.append(self.words, 0)[np.minimum(self.at[:, None] + offset, len(self.words))], -1)

    def order(self, rows: np.ndarray) -> np.ndarray:
        """Of each phrase, the place of its rarest term first; places that it lacks last."""
        return np.argsort(np.where(rows >= 0, np.append(self.counts, 0)[rows], np.iinfo(np.int64).max), 1, kind="stable")

    def items_of(self, phrases: list[int]) -> list[int]:
        return np.unique(np.concatenate([self.items[self.first[p] : self.first[p + 1]] for p in phrases])).tolist() if phrases else []


def build_index(docs: DataFrame) -> DataFrame:
    """The segments of docs (doc_id, text), with the postings of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in texts_of(batches, "text", kind=ALNUM, fold=True):
            distinct, number = np.unique(w.hash, return_inverse=True)
            row = {
                "doc_ids": batch.column(0).to_pylist(),
                "keys": batch.column(2).to_pylist(),
                "counts": w.counts.tolist(),
                "terms": planes(distinct),
                "ends": planes(np.cumsum(np.bincount(number, minlength=len(distinct))).astype(np.int32)),
                "positions": planes(np.argsort(number, kind="stable").astype(np.int32)),
            }
            yield pa.RecordBatch.from_pylist([row], _SEGMENT)

    return in_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), run, _INDEX)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SEGMENT = pa.schema([("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("terms", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary())])
_HITS = "doc_id long, key long, n_words long, spans array<struct<start: int, end: int>>, items array<long>, near array<long>"


def _find(of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted array, and whether they are there."""
    if not len(of):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return i, of[i] == x


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the given sorted terms, of a slice, occurs in the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for t, e in zip(batch.column(0), batch.column(1)):
                i, there = _find(terms, numbers(t.as_buffer(), np.uint64))
                np.add.at(total, i[there], np.diff(numbers(e.as_buffer(), np.int32), prepend=np.int32(0))[there])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "n"])

    found = in_batches(index.select("terms", "ends"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(len(terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


class _Segment:
    """A row of the index, with its terms numbered as the phrases' terms; postings are sorted by (term, position)."""

    def __init__(self, row: dict, terms: np.ndarray):
        own, ends, positions = numbers(row["terms"], np.uint64), numbers(row["ends"], np.int32).astype(np.int64), numbers(row["positions"], np.int32)
        number, there = _find(terms, own)
        sizes = np.diff(ends, prepend=0)
        self.postings = (np.repeat(number, sizes) << 32 | positions)[np.repeat(there, sizes)]
        self.first = np.searchsorted(self.postings, np.arange(len(terms) + 1) << 32)
        self.counts = np.array(row["counts"], np.int64)
        self.doc_first = np.concatenate(([0], np.cumsum(self.counts)))

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_first, position, "right") - 1

    def candidates(self, rows: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases whose terms are all here, with the postings of each one's rarest term: pieces of about PIECE postings."""
        here = np.append(np.diff(self.first) > 0, True)  # a lack of a term, -1, is never in the way
        some = np.flatnonzero(here[rows].all(1))
        term = rows[some, order[some, 0]]
        a, n = self.first[term], self.first[term + 1] - self.first[term]
        piece = np.cumsum(n) // PIECE
        for lo, hi in zip(np.searchsorted(piece, u := np.unique(piece)), np.searchsorted(piece, u, "right")):
            k, size = slice(lo, hi), n[lo:hi]
            at = np.repeat(a[k] - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield np.repeat(some[k], size), self.postings[at] & 0xFFFFFFFF

    def near(self, phrase: np.ndarray, centre: np.ndarray, rows: np.ndarray, order: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates around which all terms of the phrase lie within distance, in the same document."""
        for level in range(1, rows.shape[1]):
            t, doc = rows[phrase, order[phrase, level]], self.doc(centre)
            low, high = np.maximum(centre - distance, self.doc_first[doc]), np.minimum(centre + distance, self.doc_first[doc + 1] - 1)
            ok = (t < 0) | (np.searchsorted(self.postings, t << 32 | high, "right") > np.searchsorted(self.postings, t << 32 | low))
            phrase, centre = phrase[ok], centre[ok]
        return phrase, centre

    def starts(self, phrase: np.ndarray, centre: np.ndarray, rows: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that are a whole phrase, with the position where it begins."""
        start = centre - order[phrase, 0]
        end = start + sizes[phrase] - 1
        ok = (start >= 0) & (end < self.doc_first[-1])
        phrase, start, end = phrase[ok], start[ok], end[ok]
        ok = self.doc(start) == self.doc(end)
        phrase, start = phrase[ok], start[ok]
        for level in range(1, rows.shape[1]):
            offset = order[phrase, level]
            term = rows[phrase, offset]
            ok = (term < 0) | _find(self.postings, term << 32 | start + offset)[1]
            phrase, start = phrase[ok], start[ok]
        return phrase, start


def _by_document(doc: np.ndarray, phrase: np.ndarray, n: int) -> list[list[int]]:
    """The phrases of each document."""
    out: list[list[int]] = [[] for _ in range(n)]
    for d, p in np.unique(np.stack([doc, phrase]), axis=1).T.tolist() if len(doc) else ():
        out[d].append(p)
    return out


def search(index: DataFrame, phrases: Phrases, distance: int = NEAR) -> DataFrame:
    """doc_id, key, n_words, spans, items, near of each document of the index, for a slice of phrases with their counts."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        rows = phrases.rows()
        order = phrases.order(rows)
        sizes = phrases.sizes.astype(np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                s = _Segment(row, phrases.terms)
                n = len(s.counts)
                edge = np.zeros(int(s.doc_first[-1]) + 1, np.int64)
                whole, close = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
                for phrase, centre in s.candidates(rows, order):
                    phrase, centre = s.near(phrase, centre, rows, order, max(distance, phrases.window - 1))
                    close.append(np.unique(np.stack([s.doc(centre), phrase]), axis=1))
                    phrase, start = s.starts(phrase, centre, rows, order, sizes)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + sizes[phrase], -1)
                    whole.append(np.unique(np.stack([s.doc(start), phrase]), axis=1))
                hit = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                spans: list[list] = [[] for _ in range(n)]
                for a, z in zip(turns[::2].tolist(), turns[1::2].tolist()):
                    for d in range(int(s.doc(np.array(a))), int(s.doc(np.array(z - 1))) + 1):
                        if (lo := max(a, int(s.doc_first[d]))) < (hi := min(z, int(s.doc_first[d + 1]))):
                            spans[d].append({"start": lo - int(s.doc_first[d]), "end": hi - int(s.doc_first[d])})
                items, near = ([phrases.items_of(p) for p in _by_document(*np.concatenate(x, 1), n)] for x in (whole, close))
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(s.counts), pa.array(spans, _SPANS), *(pa.array(x, pa.list_(pa.int64())) for x in (items, near))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_words", "spans", "items", "near"])

    return in_batches(index, run, _HITS)


def _slices(items: DataFrame, slice_bytes: int) -> Iterator[pa.Table]:
    """The items, in tables of bounded size."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / slice_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield items.where(of == k).toArrow()


def find_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, distance: int = NEAR) -> DataFrame:
    """doc_id, key (a hash of the text), n_words, n_hit, spans (runs of hit words: start, end), items (ids of those with occurring windows) and near of each document.

    near: ids of items with a window whose terms all lie within distance words (a window's length at least) of its rarest term.
    """
    index = stored(build_index(docs), "postings")
    found = []
    for part in _slices(items, slice_bytes):
        phrases = Phrases(part, window)
        phrases.counts = term_counts(index, phrases.terms)
        found.append(search(index, phrases, distance).withColumn("slice", F.lit(len(found))))
        if len(found) > 1:  # a slice's phrases are with the workers for its own pass only
            found = [stored(f, "hits") for f in found] if len(found) == 2 else [*found[:-1], stored(found[-1], "hits")]
    hits = found[0]
    if len(found) > 1:  # rows of one doc_id and text have equal hits in a slice, so a row of each is enough
        one = stored(reduce(DataFrame.union, found).groupBy("slice", "doc_id", "key", "n_words", "spans", "items", "near").agg(F.count("*").alias("n")), "hits")
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        united = one.groupBy("doc_id", "key", "n_words").agg(F.max("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), every("items"), every("near"))
        hits = united.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "key", "n_words", "spans", "items", "near")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n")),
        lambda acc: acc["n"],
    )
    return hits.select("doc_id", "key", "n_words", covered.alias("n_hit"), "spans", "items", "near")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_phrases(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.size("near").cast("long").alias("n_near"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

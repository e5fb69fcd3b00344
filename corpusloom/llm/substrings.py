"""Substring deduplication: an exact join on hashes of runs, prefiltered by winnowed anchors.

Every run of LENGTH words selects one of its word K-grams, the rightmost of least hash; equal runs select
equal anchors. Blocks of documents exchange anchors by hash range and learn which
of theirs occur elsewhere. Only of runs that select such an anchor the blocks exchange
the hashes with their first place, and learn which begin earlier elsewhere; matches are
not aligned or extended word by word. Overlapping runs of a document join into its repeats, and their words go.
Runs are equal if two hashes of theirs are, of 64 and of 32 bits: among 10**12 exchanged runs a false equality has a chance of about 10**-5.

Text moves once, into blocks of bounded size; what blocks send is packed and holds
each hash once a block, so neither a hot passage nor a hot copy gathers in one task.

Defined results: null and empty texts have no words; rows of one doc_id count as one document, and
none of two equal places is the earlier; null doc_ids come last; runs never cross
texts; documents shorter than LENGTH keep everything; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.blocks import Blocks, numbers, pack, planes, ranges, unpack
from corpusloom.llm.tables import in_groups, read
from corpusloom.llm.words import U64, Words, column

LENGTH = 20
K = 6


def anchors_of_runs(w: Words, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of length words begin (those inside one text), and each one's anchor."""
    h = w.grams(k)
    runs = len(w.hash) - length + 1
    if runs <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(h))
    span, width = 1, length - k + 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] <= h[left], right, left)
        span += step
    inside = np.flatnonzero(w.within(length))
    return inside, h[at[:runs]][inside]


def _words(t: pa.Table) -> Words:
    t = t.combine_chunks()
    batch = t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)
    return Words(*column(batch, "text"))


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """True where x is in the sorted array."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def _heard(t: pa.Table) -> np.ndarray:
    """All hashes that other tasks sent a block, sorted."""
    lists = [unpack(x) for x in t.column("hashes").to_pylist()]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


_SENT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary())])
_PLACED = pa.schema([*_SENT, ("checks", pa.binary()), ("seqs", pa.binary()), ("starts", pa.binary())])
_TOLD = pa.schema([("block", pa.int32()), ("hashes", pa.binary())])
_TOLD_RUNS = pa.schema([*_TOLD, ("checks", pa.binary())])


def _seeds(blocks: Blocks) -> DataFrame:
    """block, hashes: the anchors of a block that other blocks hold too."""
    parts = blocks.parts

    def send(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        h = np.unique(anchors_of_runs(_words(t))[1])
        return _table([(p, block, pack(h[s])) for p, s in ranges(h, parts)], _SENT)

    def answer(t: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in t.column("hashes").to_pylist()]
        distinct, times = np.unique(np.concatenate(lists), return_counts=True)
        shared = distinct[times > 1]
        out = [(b, h[_member(h, shared)]) for b, h in zip(t.column("block").to_pylist(), lists)]
        return _table([(b, pack(h)) for b, h in out if len(h)], _TOLD)

    sent = in_groups(blocks.table.select("block", "text").groupBy("block"), send, "part int, block int, hashes binary")
    return in_groups(sent.groupBy("part"), answer, "block int, hashes binary")


@dataclass
class Runs:
    """Runs of LENGTH words: hash, a second one (check), seq of the document and start in it."""

    h: np.ndarray
    check: np.ndarray
    seq: np.ndarray
    start: np.ndarray

    def __getitem__(self, which) -> Runs:
        return Runs(self.h[which], self.check[which], self.seq[which], self.start[which])

    def first_places(self) -> Runs:
        """Of equal runs the one with the least (seq, start); sorted by hash and check."""
        order = np.lexsort((self.start, self.seq, self.h))
        same = self.h[order[1:]] == self.h[order[:-1]]
        apart = same & (self.check[order[1:]] != self.check[order[:-1]])
        if apart.any():  # of one hash, but not equal
            order = np.lexsort((self.start, self.seq, self.check, self.h))
            same = (self.h[order[1:]] == self.h[order[:-1]]) & (self.check[order[1:]] == self.check[order[:-1]])
        first = np.ones(len(order), bool)
        first[1:] = ~same
        return self[order[first]]

    def later_than(self, first: Runs) -> np.ndarray:
        """True for runs that begin later than the equal one among first, which first_places gave."""
        i, there = _find(self.h, self.check, first.h, first.check)
        if not there.any():
            return there
        return there & ((self.seq > first.seq[i]) | (self.seq == first.seq[i]) & (self.start > first.start[i]))


def _find(h: np.ndarray, check: np.ndarray, of_h: np.ndarray, of_check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs among sorted ones, and whether they are there."""
    if not len(of_h):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    i = np.minimum(np.searchsorted(of_h, h), len(of_h) - 1)
    while True:  # other runs of one hash follow each other by their checks
        on = np.flatnonzero((of_h[i] == h) & (of_check[i] < check) & (i + 1 < len(of_h)))
        on = on[of_h[i[on] + 1] == h[on]]
        if not len(on):
            return i, (of_h[i] == h) & (of_check[i] == check)
        i[on] += 1


def _runs(t: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, Runs]:
    """Words; of each run its place among them, its anchor, and itself."""
    w = _words(t)
    at, anchor = anchors_of_runs(w)
    text = w.text[at]
    check = (w.grams(LENGTH, 4)[at] >> U64(32)).astype(np.uint32)
    return w, at, anchor, Runs(w.grams(LENGTH, 3)[at], check, t.column("seq").to_numpy()[text], (at - w.first[text]).astype(np.int32))


def _together(lists: list[Runs]) -> Runs:
    return Runs(*(np.concatenate([getattr(r, f) for r in lists]) for f in ("h", "check", "seq", "start")))


def _repeats(blocks: Blocks, seeds: DataFrame) -> DataFrame:
    """block, hashes, checks: the runs of a block that begin earlier in another block."""
    parts = blocks.parts

    def extend(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows or not told.num_rows:
            return _PLACED.empty_table()
        block = t.column("block")[0].as_py()
        _, _, anchor, runs = _runs(t)
        r = runs[_member(anchor, _heard(told))].first_places()
        return _table([(p, block, pack(r.h[s]), planes(r.check[s]), planes(r.seq[s]), planes(r.start[s])) for p, s in ranges(r.h, parts)], _PLACED)

    def answer(t: pa.Table) -> pa.Table:
        lists = [Runs(unpack(h), numbers(c, np.uint32), numbers(q, np.int64), numbers(a, np.int32)) for h, c, q, a in zip(*(t.column(n).to_pylist() for n in ("hashes", "checks", "seqs", "starts")))]
        first = _together(lists).first_places()
        out = []
        for b, r in zip(t.column("block").to_pylist(), lists):
            r = r[r.later_than(first)]
            if len(r.h):
                out.append((b, pack(r.h), planes(r.check)))
        return _table(out, _TOLD_RUNS)

    docs = blocks.table.select("block", "seq", "text").groupBy("block")
    sent = in_groups(docs.cogroup(seeds.groupBy("block")), extend, "part int, block int, hashes binary, checks binary, seqs binary, starts binary")
    return in_groups(sent.groupBy("part"), answer, "block int, hashes binary, checks binary")


def _heard_runs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and checks of all runs that other tasks told a block of, sorted."""
    h, c = (np.concatenate([x, *(f(v) for v in t.column(n).to_pylist())]) for n, f, x in (("hashes", unpack, np.zeros(0, np.uint64)), ("checks", lambda b: numbers(b, np.uint32), np.zeros(0, np.uint32))))
    order = np.lexsort((c, h))
    return h[order], c[order]


def find_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed, repeats (maximal runs of words to remove: start, end) and kept (the other words, joined by a space)."""
    added = "n_words long, n_removed long, repeats array<struct<start: int, end: int>>, kept string"
    names = ["n_words", "n_removed", "repeats", "kept", "seq", "block"]
    docs = docs.drop(*names)
    carried = docs.columns
    blocks = Blocks(docs)
    repeats = _repeats(blocks, _seeds(blocks))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(added).fields])

    def mark(t: pa.Table, told: pa.Table) -> pa.Table:
        w, at, _, runs = _runs(t)
        gone = runs.later_than(runs.first_places()) | _find(runs.h, runs.check, *_heard_runs(told))[1]
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        raw, n_removed, spans, kept = w.bytes.tobytes(), [], [], []
        for a, z, lo, hi in zip(w.first[:-1], w.first[1:], w.offsets[:-1], w.offsets[1:]):
            c = covered[a:z]
            turns = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0]))))
            words = raw[lo:hi].split()
            n_removed.append(int(c.sum()))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2])])
            kept.append(b" ".join(words if not len(turns) else [x for x, g in zip(words, c) if not g]))
        made = [
            pa.array(w.counts, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.binary()).view(pa.string()),
        ]
        return pa.Table.from_arrays([*(t.column(c) for c in carried), *made], [*carried, "n_words", "n_removed", "repeats", "kept"])

    return in_groups(blocks.table.groupBy("block").cogroup(repeats.groupBy("block")), mark, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

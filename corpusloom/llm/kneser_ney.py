"""Language-model scoring by an interpolated modified Kneser-Ney model of ORDER words, of pairs unless another order is given.

Spark counts the longest grams of training texts: tasks combine what they read into sorted hash lists, and
each range of hashes merges its lists into one sorted array of hashes with counts. One further pass for each
lower order k sums over all training tokens, gram by gram of k words: how many different words come before it (each
occurrence adds 1 / c, so that the c occurrences of a longer gram make one), and for its part as a context how often it has
followers, and how many distinct ones occur once, twice, more often. The last pass also counts the words themselves.

P(w | u v) = max(a(u v w) - D(a(u v w)), 0) / a(u v) + gamma(u v) P(w | v), with three discounts for each order by counts of counts; a counts
occurrences in the longest grams and distinct words before in all others; under single words lies 1 / (V + 1): the
vocabulary and one unknown word. Every text begins after marks of its own and ends with a token that is predicted.

The arrays lie in the shared folder, which all workers mount. A range covers about RANGE_BYTES of text, so ranges grow in number and not in size;
a file holds some ranges that follow each other. A task looks up the sorted hashes of a chunk of texts and keeps at most OPEN files
mapped until its end, however many there are; beyond MOST files of PER_FILE ranges (about a terabyte of text) files grow instead. A lost executor's files are written again with the same content. Nothing is pruned.

Grams of one 64-bit hash count as one.

Defined results: null and empty texts are one end token; very long ones are counted and scored whole, a chunk of their own; a null doc_id is held out; repeated rows
teach and are scored each; without training texts every model probability is that of an
unknown word, 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.blocks import numbers, pack, planes, ranges, unpack
from corpusloom.llm.tables import in_batches, read, shared_dir
from corpusloom.llm.words import U64, Words, mix, texts_of

FOLDS = 10
ORDER = 2
#: Bytes of training text behind one range of hashes, about.
RANGE_BYTES = 8 << 20
#: A file for each range up to FEW, then one for every PER_FILE ranges up to MOST, then MOST.
FEW, PER_FILE, MOST = 256, 8, 16_384
#: Files that a task keeps mapped.
OPEN = 256
#: Distinct hashes that a task combines before it sends them on.
COMBINED = 1 << 21
_BEGIN, _END = (mix(np.array([n], np.uint64), 77)[0] for n in (1, 2))
_BASE_ADD = 0.1


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: every tenth by hash."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


def grams(w: Words, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the 1 to order words that end at each token; of the 0 to order - 1 words before it (none: 0); where each text's tokens begin.

    Every text has one end, a token, and marks before its first word.
    """
    end = w.first[1:] + np.arange(w.texts)
    token = np.empty(len(w.hash) + w.texts, np.uint64)
    token[end] = _END
    inner = np.ones(len(token), bool)
    inner[end] = False
    token[inner] = w.hash
    first = end - w.counts
    found, before, marks = [token], [np.zeros(len(token), np.uint64)], np.array([_BEGIN])
    for k in range(2, order + 1):
        context = np.empty_like(token)
        context[1:] = found[-1][:-1]
        context[first] = marks[0]
        before.append(context)
        found.append(longer(context, token, k))
        marks = longer(marks, np.array([_BEGIN]), k)
    return found, before, first


def longer(context: np.ndarray, token: np.ndarray, k: int) -> np.ndarray:
    """Hashes of grams of k words."""
    return mix(context * U64(0x9E3779B97F4A7C15) + token, 3 + k)


def combined(h: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct hashes, sorted, with the sums of each list of values."""
    h = np.concatenate(h)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], [np.add.reduceat(np.concatenate(v)[order], first) if len(first) else np.concatenate(v) for v in values]


def _by_value(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """For counts 1, 2 and more, from the counts of counts; 0.5, 1, 1.5 where they give none in (0, count)."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k
        out.append(d if 0 < d < k else 0.5 * k)
    return out[0], out[1], out[2]


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts >= 3, d[2], np.where(counts == 2, d[1], np.where(counts == 1, d[0], 0.0)))


def _small(a: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


class Writer:
    """One file of sorted arrays: ranges are appended, then the file comes whole or not at all; writing it again changes nothing."""

    def __init__(self, path: str, kinds: dict[str, type]):
        self.path, self.kinds, self.most = path, kinds, dict.fromkeys(kinds, 0)
        self.own = f"{path}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.parts = {name: open(f"{self.own}.{name}", "w+b") for name in kinds}

    def append(self, **arrays: np.ndarray) -> None:
        for name, a in arrays.items():
            a = a.astype(self.kinds[name])
            if len(a):
                self.most[name] = max(self.most[name], a.max())
            self.parts[name].write(a.tobytes())

    def close(self) -> None:
        """All arrays behind each other, counts in the narrowest type, then where they are."""
        places, at = {}, 0
        with open(self.own, "wb") as out:
            for name, f in self.parts.items():
                kind = np.dtype(self.kinds[name])
                small = np.min_scalar_type(int(self.most[name])) if kind == np.int64 else kind
                n = f.seek(0, os.SEEK_END) // kind.itemsize
                f.seek(0)
                places[name] = (small.str, at, n)
                while data := f.read(1 << 23):
                    at += out.write(np.frombuffer(data, kind).astype(small).tobytes())
                at += out.write(b"\0" * (-at % 8))
                f.close()
                os.remove(f.name)
            end = json.dumps(places).encode()
            out.write(end + len(end).to_bytes(8, "little"))
        os.replace(self.own, self.path)


class Store:
    """Tables of sorted hashes and their values, in files that hold some ranges of hashes each."""

    def __init__(self, at: str, parts: int):
        self.at, self.parts = at, parts
        self.files = min(parts, MOST, max(FEW, math.ceil(parts / PER_FILE)))

    def file_of(self, part):
        return part * self.files // self.parts

    def path(self, table: str, file: int) -> str:
        return f"{self.at}/{table}-{file}"


_open: OrderedDict[str, dict[str, np.ndarray] | None] = OrderedDict()


def _mapped(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped; None if no range of it holds anything. The files that were used last stay mapped."""
    if path in _open:
        _open.move_to_end(path)
        return _open[path]
    while len(_open) >= OPEN:
        _open.popitem(last=False)
    found = None
    if os.path.exists(path):
        raw = np.memmap(path, np.uint8, "r")
        size = int(raw[-8:].view("<u8")[0])
        places = json.loads(raw[-8 - size : -8].tobytes())
        found = {name: raw[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in places.items()}
    _open[path] = found
    return found


def unmapped(run):
    """What run yields; the maps that it opened go as the task ends."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _open.clear()

    return one


def look_up(store: Store, table: str, h: np.ndarray, **kinds) -> list[np.ndarray]:
    """For each hash its values in a table, by name, 0 where it is unknown."""
    distinct, number = np.unique(h, return_inverse=True)
    found = [np.zeros(len(distinct), k) for k in kinds.values()]
    for file, s in ranges(distinct, store.parts, store.file_of):
        if (t := _mapped(store.path(table, file))) is None:
            continue
        own = t["hashes"]
        i = np.minimum(np.searchsorted(own, distinct[s]), len(own) - 1)
        there = own[i] == distinct[s]
        for out, name in zip(found, kinds):
            out[s][there] = t[name][i[there]]
    return [x[number] for x in found]


def _sent(batches: Iterator[pa.RecordBatch], store: Store, kinds: list, make) -> Iterator[pa.RecordBatch]:
    """What make(words) gives for each chunk, combined, as a packed row for each range."""
    kept_h: list[np.ndarray] = []
    kept_v: list[list[np.ndarray]] = [[] for _ in kinds]

    def flush() -> Iterator[pa.RecordBatch]:
        h, v = combined(kept_h, kept_v)
        for part, s in ranges(h, store.parts):
            sums = [planes(_small(x[s]) if np.issubdtype(k, np.integer) else x[s].astype(k)) for x, k in zip(v, kinds)]
            row = [pa.array([store.file_of(part)], pa.int32()), pa.array([part], pa.int32()), pa.array([pack(h[s])], pa.binary()), pa.array([sums], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(row, ["file", "part", "hashes", "sums"])

    for _, w in texts_of(batches, "text", fold=True):
        h, v = make(w)
        kept_h.append(h)
        for a, x in zip(kept_v, v):
            a.append(x)
        if sum(map(len, kept_h)) >= COMBINED:
            h, v = combined(kept_h, kept_v)
            kept_h, kept_v = [h], [[x] for x in v]
            if len(h) >= COMBINED // 2:
                yield from flush()
                kept_h, kept_v = [], [[] for _ in kinds]
    if kept_h:
        yield from flush()


def _merged(rows: list[tuple[bytes, list[bytes]]], kinds: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes of a range with their sums."""
    h = [unpack(x) for x, _ in rows]
    sums: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, (_, row) in zip(map(len, h), rows):
        for out, x, k in zip(sums, row, kinds):
            width = len(x) // n
            out.append(numbers(x, f"u{width}" if np.issubdtype(k, np.integer) else k).astype(k))
    return combined(h, sums)


def _tabulate(texts: DataFrame, store: Store, table: str, kinds: list, make, columns: dict[str, type], keep) -> list[float]:
    """Writes a table of what make gives, as keep(hashes, sums) arranges it by column; the sums of the numbers that keep also gives.

    A task writes a file of its own, range by range.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = part = None
        held: list[tuple[bytes, list[bytes]]] = []
        total = 0.0

        def append() -> None:
            nonlocal total
            arrays, counts = keep(*_merged(held, kinds))
            writer.append(**arrays)
            total = total + np.array(counts, np.float64)

        for batch in batches:
            for i in range(batch.num_rows):
                file, this, h, sums = (batch.column(k)[i].as_py() for k in range(4))
                if this != part and held:
                    append()
                    held = []
                if writer is None:
                    writer = Writer(store.path(table, file), columns)
                part = this
                held.append((h, sums))
        if writer is not None:
            append()
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["numbers"])

    sent = in_batches(texts, unmapped(lambda b: _sent(b, store, kinds, make)), "file int, part int, hashes binary, sums array<binary>")
    dealt = sent.repartitionById(store.files, "file").sortWithinPartitions("part")
    found = in_batches(dealt, write, "numbers array<double>").select(F.posexplode("numbers").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return [r.x for r in found]


@dataclass
class Model:
    """Where the arrays lie and the few numbers that hold for all words; discounts by order from 1 on."""

    store: Store
    order: int
    tokens: int = 0
    distinct: int = 0
    pairs: int = 0
    gamma: float = 1.0
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)

    def counts(self, k: int, h: np.ndarray) -> np.ndarray:
        """Of grams of k words: occurrences of the longest, distinct words before others."""
        return look_up(self.store, f"grams{k}", h, a=np.float64)[0]

    def log10(self, found: list[np.ndarray], before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token, by the hashes that grams gives: log10 of the model's probability and of the base's, and its count."""
        size = len(found[0])
        p = total = gamma = n = None
        for k in range(1, self.order + 1):
            if k == self.order:
                a = self.counts(k, found[k - 1])
            else:
                both = np.concatenate([found[k - 1], before[k]])
                if k == 1:
                    a, total_, gamma_, n = look_up(self.store, "grams1", both, a=np.float64, total=np.float64, gamma=np.float64, n=np.int64)
                    n = n[:size]
                else:
                    a, total_, gamma_ = look_up(self.store, f"grams{k}", both, a=np.float64, total=np.float64, gamma=np.float64)
                a = a[:size]
            if k == 1:
                p = (a - _discount(a, self.discounts[1])) / max(1, self.pairs) + self.gamma / (self.distinct + 1)
            else:
                p = np.where(total > 0, (a - _discount(a, self.discounts[k])) / np.maximum(1, total) + gamma * p, p)
            if k < self.order:
                total, gamma = total_[size:], gamma_[size:]
        base = np.log10((n + _BASE_ADD) / (self.tokens + _BASE_ADD * (self.distinct + 1)))
        return np.log10(p), base, n


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts all texts of docs; each column text."""
    if order < 2:
        raise ValueError("the model has pairs of words at least")
    at = f"{shared_dir(docs.sparkSession)}/grams-{uuid.uuid4().hex}"
    url = urlparse(at)
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers can't map files of {at}; name a mounted folder in spark.checkpoint.dir")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = docs.select("text")
    model = Model(Store(unquote(url.path) if url.scheme else at, max(1, math.ceil(size / RANGE_BYTES))), order)

    def count(w: Words):
        h = np.sort(grams(w, order)[0][-1])
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], [np.diff(np.append(first, len(h)))]

    def keep_longest(h: np.ndarray, sums: list[np.ndarray]):
        return {"hashes": h, "a": sums[0]}, [0, *_by_value(sums[0])]

    _, *by = _tabulate(texts, model.store, f"grams{order}", [np.int64], count, {"hashes": np.uint64, "a": np.int64}, keep_longest) or [0] * 5
    model.discounts[order] = discounts(by)

    for k in range(order - 1, 0, -1):
        whole = np.int64 if k == order - 1 else np.float64
        kinds = [np.float64, whole, whole, np.float64, np.float64, *([np.int64] if k == 1 else [])]

        def sums_of(w: Words, k=k, kinds=kinds, model=model):
            found, before, _ = grams(w, order)
            share, longer_counts = np.ones(len(found[0])), None
            for m in range(order, k, -1):  # what an occurrence adds to the distinct words before: 1 over all occurrences of one longer gram
                weight, longer_counts = share, model.counts(m, found[m - 1])
                share = share / longer_counts
            h, number = np.unique(np.concatenate([found[k - 1], before[k]]), return_inverse=True)
            t, b = number[: len(share)], number[len(share) :]
            each = lambda of, x: np.bincount(of, x, len(h))
            followed = [each(b, np.where(which, share, 0.0)) for which in (longer_counts < 1.5, (longer_counts > 1.5) & (longer_counts < 2.5), longer_counts > 2.5)]
            out = [each(t, share), each(b, weight), *followed, *([np.bincount(t, minlength=len(h))] if k == 1 else [])]
            return h, [np.rint(x).astype(np.int64) if kind == np.int64 else x for x, kind in zip(out, kinds)]

        def keep(h: np.ndarray, sums: list[np.ndarray], k=k, d=model.discounts[k + 1]):
            a, total, once, twice, often = (np.rint(x) for x in sums[:5])
            arrays = {"hashes": h, "a": a, "total": total, "gamma": (d[0] * once + d[1] * twice + d[2] * often) / np.maximum(1, total)}
            n = int(sums[5].sum()) if k == 1 else 0
            return arrays | ({"n": sums[5]} if k == 1 else {}), [int(a.sum()), *_by_value(a), int((a > 2).sum()), int((a > 0).sum()), n]

        columns = {"hashes": np.uint64, "a": np.int64, "total": np.int64, "gamma": np.float64} | ({"n": np.int64} if k == 1 else {})
        pairs, one, two, three, four, more, distinct, n = _tabulate(texts, model.store, f"grams{k}", kinds, sums_of, columns, keep) or [0] * 8
        model.discounts[k] = d = discounts([one, two, three, four])
    model.tokens, model.distinct, model.pairs = int(n), int(distinct), int(pairs)
    model.gamma = (d[0] * one + d[1] * two + d[2] * more) / pairs if pairs else 1.0
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in texts_of(batches, "text", fold=True):
            found, before, first = grams(w, model.order)
            ours, base, n = model.log10(found, before)
            size = w.counts + 1
            total = np.add.reduceat(ours, first)
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array(size, pa.int64()),
                pa.array(np.add.reduceat((n > 0).astype(np.int64), first), pa.int64()),
                pa.array(np.full(w.texts, model.tokens), pa.int64()),
                pa.array(np.add.reduceat(base, first)),
                pa.array(total),
                pa.array(10.0 ** np.minimum(300, -total / size)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return in_batches(rows, unmapped(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs.where(~held_out()).select("text")))

"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of an embedding of the word and of embeddings of all its runs of 3 and of 5 characters, told apart at
its beginning and at its end, so an altered form of a known word is known in part. Two GRUs read
a window of words, attention pools their states, and a logistic layer scores
the window. All windows of a text, STRIDE words apart and WINDOW long, are scored; the
text's score is that of its worst window, calibrated on whole texts.

The network is trained in numpy on the driver, on a bounded sample: of each label at most SAMPLE texts, by least hash of doc_id, and of these the
first SAMPLE_BYTES of whole texts (of rows with one doc_id the largest text). Labels come only from rows that are not held out; label, language, source and doc_id are no inputs.
Tasks count the inputs of these whole texts; known are the FEATURES that differ most between the labels, each seen in more than SEEN texts, and the words of a SHARE of
all texts, COMMON at most (runs that are as common would only learn these texts by heart). All windows of these texts teach: every
epoch takes the window of each toxic text, and two of each clean one, that the network then finds worst or draws; so it learns which window bears the label. A fifth of the sample
does not train: on its whole texts the scores are calibrated (on all, if it has fewer than CALIBRATE texts of a label).
Workers get the weights (under a megabyte) and score whole texts chunk by chunk.

Defined results: texts without words score 0, as nothing in them is toxic; repeated rows score
alike; without labels of both kinds every score is the share of label 1, smoothed;
an empty table gives no rows; other columns pass through, but older held_out, score and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.llm.tables import in_batches, partitions, read, stored
from corpusloom.llm.words import ALNUM, U64, Words, mix, signed, texts_of

WINDOW, STRIDE = 64, 48
#: Characters of the runs of a word that are inputs.
RUNS = (3, 5)
SAMPLE, SAMPLE_BYTES, CALIBRATE = 1_500, 64 << 20, 8
FEATURES, TELLING, COMMON, SHARE, SEEN = 12_000, 2.3, 4_000, 0.1, 3
FOLDS = 5
#: Windows that a worker scores at once.
BATCH = 1_024
#: The logit of a text without words.
NOTHING = -1e6
_D, _H, _A = 8, 8, 8  # sizes of inputs, of a direction's state, of attention
_EPOCHS, _STEPS, _BATCH, _RATE = 8, 240, 128, 0.01  # epochs, but steps at least
_MASK = (1 << 20) - 1
_EDGES = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: every fifth by hash."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


@dataclass
class Inputs:
    """Of distinct words: those of word i are of[first[i] : first[i + 1]], the first of them the word itself."""

    of: np.ndarray
    first: np.ndarray

    def only(self, known: np.ndarray) -> Inputs:
        """Those that are known, by the numbers that known has for each."""
        there = known > 0
        return Inputs(known[there], np.concatenate(([0], np.cumsum(there)))[self.first])

    def sums(self, e: np.ndarray) -> np.ndarray:
        """The sum of the rows of e that each word's inputs number."""
        out = np.zeros((len(self.first) - 1, e.shape[1]), e.dtype)
        some = np.flatnonzero(self.first[1:] > self.first[:-1])
        if len(some):
            out[some] = np.add.reduceat(e[self.of], self.first[some])
        return out

    def take(self, words: np.ndarray) -> Inputs:
        size = (self.first[1:] - self.first[:-1])[words]
        first = np.concatenate(([0], np.cumsum(size)))
        return Inputs(self.of[np.repeat(self.first[words] - first[:-1], size) + np.arange(first[-1])], first)


def inputs(w: Words) -> tuple[Inputs, np.ndarray]:
    """Hashes of the inputs of each distinct word, and each word's number among these."""
    _, at, number = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[at], w.end[at]
    characters = np.append(np.flatnonzero((w.bytes & 0xC0) != 0x80), len(w.bytes))
    first = np.searchsorted(characters, start)
    size = np.searchsorted(characters, end) - first
    found, owner = [w.hash[at]], [np.arange(len(at))]
    for k in RUNS:
        n = np.maximum(0, size - k + 1)
        word = np.repeat(np.arange(len(at)), n)
        i = np.arange(len(word)) + np.repeat(first - np.cumsum(n) + n, n)
        a, z = characters[i], characters[i + k]
        found.append(mix(w.span(a, z) + (a == start[word]) * _EDGES[0] + (z == end[word]) * _EDGES[1], 900 + k))
        owner.append(word)
    owner = np.concatenate(owner)
    return Inputs(np.concatenate(found)[np.argsort(owner, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(at)))))), number


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of every window; a text without words has one of length 0."""
    n = np.maximum(1, -(-(w.counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(w.texts), n)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, w.first[text] + at, np.minimum(WINDOW, w.counts[text] - at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Weights by name; vocabulary: sorted hashes of the known inputs, whose embeddings follow a row of zeros for unknown ones."""

    vocabulary: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def fresh(cls, vocabulary: np.ndarray, rng: np.random.Generator) -> Model:
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": np.zeros((len(vocabulary) + 1, _D), np.float32), "A": draw(2 * _H, _A), "a": np.zeros(_A, np.float32), "v": draw(_A), "u": draw(2 * _H), "c": np.zeros(1, np.float32)}
        for k in "fb":
            p |= {f"W{k}": draw(_D, 3 * _H), f"U{k}": draw(_H, 3 * _H), f"b{k}": np.zeros(3 * _H, np.float32)}
        return cls(vocabulary, p)

    def known(self, x: Inputs) -> Inputs:
        """Rows of E of the inputs that the vocabulary has."""
        some = np.zeros(_MASK + 1, bool)  # most hashes are unknown, and most of these end here
        some[self.vocabulary & U64(_MASK)] = True
        out = np.zeros(len(x.of), np.int64)
        at = np.flatnonzero(some[x.of & U64(_MASK)])
        if len(at):
            i = np.minimum(np.searchsorted(self.vocabulary, x.of[at]), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[i] == x.of[at], i + 1, 0)
        return x.only(out)

    def _run(self, k: str, x: np.ndarray, index: np.ndarray, mask: np.ndarray, kept: list | None) -> np.ndarray:
        """States (window position, window, _H) of one direction; x has the projected inputs that index chooses."""
        p, steps = self.weights, range(len(index)) if k == "f" else range(len(index) - 1, -1, -1)
        u = p[f"U{k}"]
        h = np.zeros((index.shape[1], _H), np.float32)
        out = np.empty((*index.shape, _H), np.float32)
        for t in steps:
            xt, hu, m = x[index[t]], h @ u, mask[t][:, None]
            zr = _sigmoid(xt[:, : 2 * _H] + hu[:, : 2 * _H])
            z, r = zr[:, :_H], zr[:, _H:]
            n = np.tanh(xt[:, 2 * _H :] + r * hu[:, 2 * _H :])
            new = n + z * (h - n)
            if kept is not None:
                kept.append((t, h, z, r, n, hu[:, 2 * _H :], m))
            h = out[t] = h + m * (new - h)
        return out

    def logits(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """One for each window; x: inputs of distinct words, index and mask: (position, window)."""
        p = self.weights
        states = []
        for k in "fb":
            if kept is not None:
                kept[k] = []
            states.append(self._run(k, x @ p[f"W{k}"] + p[f"b{k}"], index, mask, None if kept is None else kept[k]))
        h = np.concatenate(states, 2)
        a = np.tanh(h @ p["A"] + p["a"])
        e = np.where(mask > 0, a @ p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(0)) * mask
        w = w / np.maximum(w.sum(0), np.float32(1e-9))
        pooled = (h * w[:, :, None]).sum(0)
        if kept is not None:
            kept |= {"h": h, "a": a, "w": w, "pooled": pooled}
        return pooled @ p["u"] + p["c"]

    def gradients(self, known: Inputs, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; known: rows of E for the inputs of distinct words, which index (position, window) numbers."""
        p, kept = self.weights, {}
        steps, n = mask.shape
        words = known.sums(p["E"])
        x = words[index.reshape(-1)]
        d = (_sigmoid(self.logits(words, index, mask, kept)) - y) / n
        g = {"u": kept["pooled"].T @ d, "c": d.sum(keepdims=True)}
        dpool = d[:, None] * p["u"]
        h, a, w = kept["h"], kept["a"], kept["w"]
        dw = (h * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        dpre = de[:, :, None] * p["v"] * (1 - a * a)
        g |= {"v": np.tensordot(de, a, 2), "A": np.tensordot(h, dpre, ((0, 1), (0, 1))), "a": dpre.sum((0, 1))}
        dh = dpool * w[:, :, None] + dpre @ p["A"].T
        dx = np.zeros((steps, n, _D), np.float32)
        for k, part in (("f", dh[:, :, :_H]), ("b", dh[:, :, _H:])):
            u, carry = p[f"U{k}"], np.zeros((n, _H), np.float32)
            du, dg = np.zeros_like(u), np.zeros((steps, n, 3 * _H), np.float32)
            for t, before, z, r, new, hu, m in reversed(kept[k]):
                total = part[t] + carry
                step = m * total
                dn = step * (1 - z) * (1 - new * new)
                dz = step * (before - new) * z * (1 - z)
                dr = dn * hu * r * (1 - r)
                back = np.concatenate([dz, dr, dn * r], 1)
                du += before.T @ back
                carry = total - step + step * z + back @ u.T
                dg[t] = np.concatenate([dz, dr, dn], 1)
            flat = dg.reshape(-1, 3 * _H)
            g |= {f"U{k}": du, f"W{k}": x.T @ flat, f"b{k}": flat.sum(0)}
            dx += (flat @ p[f"W{k}"].T).reshape(steps, n, _D)
        size, flat = np.diff(known.first), dx.reshape(-1, _D)
        of_words = np.stack([np.bincount(index.reshape(-1), flat[:, i], len(size)) for i in range(_D)], 1)
        each = np.repeat(of_words, size, axis=0)
        g["E"] = np.stack([np.bincount(known.of, each[:, i], len(p["E"])) for i in range(_D)], 1).astype(np.float32)
        g["E"][0] = 0
        return g

    def calibrated(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -500, 500)))

    def scores(self, w: Words) -> np.ndarray:
        """Of each text."""
        return np.full(w.texts, self.constant) if self.constant is not None else self.calibrated(self.worst(w))

    def worst(self, w: Words) -> np.ndarray:
        """The largest logit of each text's windows."""
        words, number = inputs(w)
        x = np.concatenate([self.known(words).sums(self.weights["E"]), np.zeros((1, _D), np.float32)])
        text, first, size = windows(w)
        worst = np.full(w.texts, -np.inf)
        for a in range(0, len(text), BATCH):
            at = np.arange(WINDOW)[:, None]
            mask = (at < size[a : a + BATCH]).astype(np.float32)
            index = np.where(mask > 0, np.append(number, 0)[np.minimum(first[a : a + BATCH] + at, len(number))], len(x) - 1)
            np.maximum.at(worst, text[a : a + BATCH], self.logits(x, index, mask))
        return np.where(w.counts > 0, worst, NOTHING)


@dataclass
class Bags:
    """Windows of texts: words as numbers, -1 where a window has ended (window, position); each one's text; labels of texts; the inputs of the words."""

    index: np.ndarray
    text: np.ndarray
    y: np.ndarray
    known: Inputs

    def batch(self, windows: np.ndarray) -> tuple[Inputs, np.ndarray, np.ndarray]:
        """The inputs, index and mask of some windows."""
        some = self.index[windows].T
        words, index = np.unique(np.maximum(some, 0), return_inverse=True)
        return self.known.take(words), index.reshape(some.shape), (some >= 0).astype(np.float32)


def train(bags: Bags, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 5) -> Model:
    """A model without calibration; odds: how much each input of the vocabulary tells of label 1."""
    if len(set(bags.y.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), constant=float((bags.y.sum() + 0.5) / (len(bags.y) + 1)) if len(bags.y) else 0.25)
    rng = np.random.default_rng(seed)
    model = Model.fresh(vocabulary, rng)
    # an input begins with how much it tells of the label, and with nothing else; training goes on from there
    model.weights["E"][1:, 0] = odds / 4
    label = bags.y[bags.text] > 0
    worst = bags.known.sums(np.maximum(np.append(0.0, odds), 0)[:, None])[:, 0]
    worst = np.where(bags.index >= 0, np.append(worst, 0.0)[bags.index], 0.0).sum(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    steps = epoch = 0
    while epoch < _EPOCHS or steps < _STEPS:
        order = np.lexsort((-worst, bags.text))  # of each text the worst window first
        first = order[np.concatenate(([True], np.diff(bags.text[order]) > 0))]
        drawn = rng.permutation(len(label))
        drawn = drawn[np.unique(bags.text[drawn], return_index=True)[1]]
        chosen = np.unique(np.concatenate([first, drawn[~label[drawn]]]))
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), _BATCH):
            some = chosen[a : a + _BATCH]
            g, steps = model.gradients(*bags.batch(some), label[some].astype(np.float32)), steps + 1
            for k, (m, v) in moments.items():
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] * g[k] - v)
                model.weights[k] -= (_RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
        epoch += 1
        worst = np.concatenate([model.logits(k.sums(model.weights["E"]), i, m) for k, i, m in (bags.batch(np.arange(a, min(a + BATCH, len(label)))) for a in range(0, len(label), BATCH))])
    return model


def _calibration(worst: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope of a logistic fit, both labels weighted alike, positive; the shift puts 0.5 where the fewest texts are on the wrong side, amid the widest such gap."""
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    mean, scale = worst.mean(), worst.std() + 1e-6
    x, b = np.stack([(worst - mean) / scale, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (q - y)) + 1e-2 * len(y) * np.array([b[0], 0.0])
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-2 * len(y), 1e-6])
        b = b - np.linalg.solve(hessian, gradient)
        b[0] = max(b[0], 0.1)
    slope = float(b[0] / scale)
    order = np.argsort(worst, kind="stable")
    at, label = worst[order], y[order] > 0
    wrong = np.cumsum(label)[:-1] + (~label).sum() - np.cumsum(~label)[:-1]  # where all from the next one on are called toxic
    gap = np.where((wrong == wrong[np.diff(at) > 0].min()) & (np.diff(at) > 0), np.diff(at), -1.0) if (np.diff(at) > 0).any() else np.array([0.0])
    k = int(gap.argmax())
    return slope, -slope * float(at[k] + at[min(k + 1, len(at) - 1)]) / 2


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y, text and part (what it is for: "train" or "calibrate") of a bounded sample of labelled texts, stored.

    Of each label SAMPLE rows at most, the first by a hash, and of these the first SAMPLE_BYTES of whole texts; a longer text is in no sample.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("y = 0").orderBy(*order).limit(SAMPLE).union(known.where("y = 1").orderBy(*order).limit(SAMPLE))
    # at most 2 * SAMPLE ids are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    whole = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("bytes", F.sum(F.octet_length("text")).over(whole)).where(F.coalesce("bytes", F.lit(0)) <= SAMPLE_BYTES)
    part = F.when(F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0, "calibrate").otherwise("train")
    return stored(texts.select("doc_id", "y", "text", part.alias("part")).repartition(partitions(docs.sparkSession), "doc_id"), "sample")


def vocabulary_of(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the known inputs, sorted, and the log odds of each for label 1, from all words of the texts (y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in texts_of(batches, "text", kind=ALNUM, fold=True):
            y = np.asarray(batch.column(0))
            x, number = inputs(w)
            for label in (0, 1):
                seen = []
                for i in np.flatnonzero((y == label) & (w.counts > 0)):
                    seen.append(np.unique(x.take(np.unique(number[w.first[i] : w.first[i + 1]])).of))
                if seen:
                    h, n = np.unique(np.concatenate(seen), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.isin(h, x.of[x.first[:-1]])), pa.array(np.where(label, 0, n)), pa.array(np.where(label, n, 0))], ["h", "word", "n0", "n1"])

    total = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return np.zeros(0, np.uint64), np.zeros(0)
    counted = in_batches(texts.select("y", "text"), run, "h long, word boolean, n0 long, n1 long").groupBy("h", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") > SEEN)
    a, b = F.col("n0") + 0.5, F.col("n1") + 0.5
    odds = F.ln(b / (total[1] + 1)) - F.ln(a / (total[0] + 1))
    counted = stored(counted.select("h", "word", (F.col("n0") + F.col("n1")).alias("n"), odds.alias("odds"), (F.abs(odds) / F.sqrt(1 / a + 1 / b)).alias("telling")), "inputs")
    telling = counted.where(F.col("telling") > TELLING).orderBy(F.desc("telling"), "h").limit(FEATURES)
    common = counted.where(F.col("word") & (F.col("n") >= SHARE * sum(total.values()))).orderBy(F.desc("n"), "h").limit(COMMON)
    rows = telling.select("h", "odds").union(common.select("h", "odds")).distinct().toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.column("odds").to_numpy()[order]


_BAGS = "doc_id long, y int, windows binary, inputs binary, ends binary"


def bags_of(texts: DataFrame, vocabulary: np.ndarray) -> Bags:
    """All windows of each text (doc_id, y, text)."""
    model = Model(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in texts_of(batches, "text", kind=ALNUM, fold=True):
            x, number = inputs(w)
            x = model.known(x)
            text, first, size = windows(w)
            rows = []
            for i, (a, z) in enumerate(zip(np.searchsorted(text, np.arange(w.texts)), np.searchsorted(text, np.arange(w.texts), "right"))):
                mine = np.arange(a, z)
                at = np.arange(WINDOW)
                index = np.where(at < size[mine, None], np.append(number, 0)[np.minimum(first[mine, None] + at, len(number))], -1)
                words, index_ = np.unique(index, return_inverse=True)
                lack = int(len(words) > 0 and words[0] < 0)
                own = x.take(words[lack:])
                rows.append([(index_.reshape(index.shape) - lack).astype(np.int32).tobytes(), own.of.astype(np.int32).tobytes(), own.first[1:].astype(np.int32).tobytes()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["doc_id", "y", "windows", "inputs", "ends"])

    rows = sorted(in_batches(texts.select("doc_id", "y", "text"), run, _BAGS).collect())
    index, text, of, sizes, n = [], [], [], [], 0
    for k, r in enumerate(rows):
        own, ends = np.frombuffer(r.windows, np.int32).reshape(-1, WINDOW), np.frombuffer(r.ends, np.int32)
        index.append(np.where(own >= 0, own + n, -1))
        text.append(np.full(len(own), k))
        of.append(np.frombuffer(r.inputs, np.int32))
        sizes.append(np.diff(ends, prepend=0))
        n += len(ends)
    together = lambda a, empty: np.concatenate(a) if a else empty
    known = Inputs(together(of, np.zeros(0, np.int64)), np.concatenate(([0], np.cumsum(together(sizes, np.zeros(0, np.int64))))).astype(np.int64))
    return Bags(together(index, np.zeros((0, WINDOW), np.int64)), together(text, np.zeros(0, np.int64)), np.array([r.y for r in rows], np.float32), known)


def fit(texts: DataFrame) -> Model:
    """The model of a bounded sample (doc_id, y, text, part), calibrated on the whole texts that don't train."""
    teach = texts.where("part = 'train'")
    vocabulary, odds = vocabulary_of(teach)
    model = train(bags_of(teach, vocabulary), vocabulary, odds)
    if model.constant is None:
        counts = {r.y: r.n for r in texts.where("part = 'calibrate'").groupBy("y").agg(F.count("*").alias("n")).collect()}
        enough = min(counts.get(0, 0), counts.get(1, 0)) >= CALIBRATE
        shared = texts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, w in texts_of(batches, "text", kind=ALNUM, fold=True):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.worst(w).astype(np.float64))], ["doc_id", "y", "worst"])

        apart = texts.where("part = 'calibrate'") if enough else texts
        rows = sorted(in_batches(apart.select("doc_id", "y", "text"), run, "doc_id long, y int, worst double").collect())
        shared.unpersist()
        worst = np.array([r.worst for r in rows])
        worst = np.maximum(worst, min(worst[worst > NOTHING], default=0.0))
        model.slope, model.shift = _calibration(worst, np.array([r.y for r in rows], np.float64))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep_text: bool = True) -> DataFrame:
    """docs, with or without the text, and held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, label)))
    docs = docs.drop("held_out", "score", "predicted")
    kept = [c for c in docs.columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in texts_of(batches, "text", kind=ALNUM, fold=True):
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(shared.value.scores(w).astype(np.float64))], [*kept, "score"])

    schema = StructType([*(f for f in docs.schema.fields if f.name in kept), StructField("score", DoubleType())])
    return in_batches(docs, run, schema).withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, read(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "held_out", "score", "predicted")

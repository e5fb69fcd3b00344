"""Nearest neighbours by largest inner product, with score-aware anisotropic quantisation.

A vector is coded by the nearest of some coarse centroids, and by four bits for each pair of components of what that leaves. Codes and centroids minimise
|r|^2 + (ETA - 1) <r, x>^2 / |x|^2, r being the residual: the part of it that is parallel to x, which moves
large inner products, costs ETA times as much as the rest. Centroids are learnt on a
bounded sample; every vector is coded and stored, in hashed segments of about SEGMENT vectors.

A query's products with all centroids are its tables. A segment is scanned by adding table entries
code byte by code byte; the DEPTH best distinct vectors are then scored exactly, in double
precision. Equal vectors of a segment are scanned once and stand for their ids, so a vector with many copies crowds nobody out.

All vectors are scanned for every query, as near-isotropic vectors leave no partition that could be skipped at this recall.
The work is a grid: hashed blocks of about QUERIES queries along one side (a segment goes out once for each of these), SEGMENTS segments along the other, both dealt by a
shuffle; a cell keeps the k best of each of its queries, and a last step ranks what the cells found. One plan does, whatever the
number of queries, and no query or candidate passes through the driver but the sample that the centroids are learnt on.

Defined results: rows with a null vec_id, and vectors that are null, zero or hold null or non-finite components, take
no part; nor do those of another length than most (of equally many, the longer); rows of one vec_id count once, with
the least vector; ties go to the smaller vec_id; fewer than k candidates are all returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.tables import in_groups, partitions, read, stored

K, EVERY = 20, 20
#: A parallel residual weighs as for products over THRESHOLD of the norms' product.
THRESHOLD = 0.2
SAMPLE = 20_000
SEGMENT, DEPTH = 8_192, 100
#: Of a cell, about.
QUERIES, SEGMENTS = 65_536, 8
_ROUNDS, _SWEEPS = 8, 3
_TILE = 64  # queries that are scanned together
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def eta(dimension: int) -> float:
    return max(1.0, (dimension - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


class Codebook:
    """Coarse centroids of whole vectors, at most 256, and sixteen centroids for each pair of components of what they leave: (pairs, 16, 2)."""

    def __init__(self, dimension: int):
        self.dimension, self.pairs = dimension, math.ceil(dimension / 4) * 2  # an even number of pairs fills bytes
        self.eta = eta(dimension)
        self.centroids = np.zeros((self.pairs, 16, 2))
        self.coarse = np.zeros((1, dimension))

    def split(self, x: np.ndarray) -> np.ndarray:
        """(pairs, vectors, 2), with zeros for components that aren't there."""
        padded = np.zeros((len(x), 2 * self.pairs))
        padded[:, : x.shape[1]] = x
        return np.ascontiguousarray(padded.reshape(len(x), self.pairs, 2).transpose(1, 0, 2))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - (self.coarse**2).sum(1) / 2).argmax(1)

    def _parallel(self, s: int, x: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return ((left[s] - self.centroids[s][codes[s]]) * x[s]).sum(1)

    def _costs(self, s: int, x: np.ndarray, left: np.ndarray, rest: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each centroid of pair s: (vectors, 16); rest: what the other pairs add to <r, x>."""
        c = self.centroids[s]
        return (left * left).sum(1)[:, None] - 2 * left @ c.T + (c * c).sum(1) + weight[:, None] * ((rest + (left * x).sum(1))[:, None] - x @ c.T) ** 2

    def codes(self, x: np.ndarray, codes: np.ndarray | None = None, sweeps: int = _SWEEPS) -> np.ndarray:
        """(pairs, vectors): the nearest centroids, then sweeps that mind the parallel residual."""
        parts, left = self.split(x), self.split(x - self.coarse[self.nearest(x)])
        weight = (self.eta - 1) / np.maximum((x * x).sum(1), 1e-300)
        zero = np.zeros(len(x))
        if codes is None:
            codes = np.stack([self._costs(s, parts[s], left[s], zero, zero).argmin(1) for s in range(self.pairs)])
        parallel = np.stack([self._parallel(s, parts, left, codes) for s in range(self.pairs)])
        total = parallel.sum(0)
        for _ in range(sweeps):
            for s in range(self.pairs):
                codes[s] = self._costs(s, parts[s], left[s], total - parallel[s], weight).argmin(1)
                new = self._parallel(s, parts, left, codes)
                total, parallel[s] = total + new - parallel[s], new
        return codes

    @classmethod
    def learn(cls, x: np.ndarray, dimension: int, seed: int = 3) -> Codebook:
        book = cls(dimension)
        if not len(x):
            return book
        rng = np.random.default_rng(seed)
        book.coarse = x[rng.choice(len(x), max(1, min(256, len(x) // 64)), replace=False)].copy()
        for _ in range(_ROUNDS):
            near = book.nearest(x)
            n = np.bincount(near, minlength=len(book.coarse))
            sums = np.zeros_like(book.coarse)
            np.add.at(sums, near, x)
            book.coarse[n > 0] = sums[n > 0] / n[n > 0, None]
        parts, left = book.split(x), book.split(x - book.coarse[book.nearest(x)])
        for s in range(book.pairs):
            book.centroids[s] = left[s][rng.choice(len(x), 16, replace=len(x) < 16)]
        weight = (book.eta - 1) / np.maximum((x * x).sum(1), 1e-300)
        codes = None
        for _ in range(_ROUNDS):
            codes = book.codes(x, codes, 1)
            parallel = np.stack([book._parallel(s, parts, left, codes) for s in range(book.pairs)])
            total = parallel.sum(0)
            for s in range(book.pairs):
                p, t, k = parts[s], left[s], codes[s]
                want = weight * (total - parallel[s] + (p * t).sum(1))
                for c in range(16):
                    own = k == c
                    if own.any():  # the minimum of a quadratic in the centroid
                        q = p[own]
                        a = own.sum() * np.eye(2) + (q * weight[own, None]).T @ q
                        book.centroids[s][c] = np.linalg.solve(a, t[own].sum(0) + want[own] @ q)
                new = book._parallel(s, parts, left, codes)
                total, parallel[s] = total + new - parallel[s], new
        return book

    def packed(self, x: np.ndarray) -> np.ndarray:
        """(vectors, bytes): two codes in each byte, the coarse centroid in the last."""
        c = self.codes(x)
        return np.concatenate([(c[0::2] | c[1::2] << 4).T, self.nearest(x)[:, None]], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): the products of each query with the centroids that a byte names."""
        t = np.einsum("sqd,scd->scq", self.split(queries), self.centroids).astype(np.float32)
        byte = np.arange(256)
        coarse = np.zeros((1, 256, len(queries)), np.float32)
        coarse[0, : len(self.coarse)] = self.coarse @ queries.T
        return np.concatenate([t[0::2][:, byte & 15] + t[1::2][:, byte >> 4], coarse])


def _usable(c: str, dimension: int | None = None) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.size(c) > 0 if dimension is None else F.size(c) == dimension
    return F.coalesce(finite & F.exists(c, lambda x: x != 0) & fits, F.lit(False))


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of all rows that take part, one for each id, and their length."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull())
    lengths = rows.where(_usable("vector")).groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "length")).alias("most")).first()["most"]
    dimension = most["length"] if most else 1
    return rows.where(_usable("vector", dimension)).groupBy("vec_id").agg(F.min("vector").alias("vector")), dimension


def _matrix(c: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(c.flatten(), np.float64).reshape(-1, dimension)


def build_index(rows: DataFrame, dimension: int) -> tuple[DataFrame, Codebook]:
    """ids, codes and vectors of each segment, and the codebook, which is learnt on at most SAMPLE vectors of least hash."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    book = Codebook.learn(_matrix(some.column("vector").combine_chunks(), dimension) if some.num_rows else np.zeros((0, dimension)), dimension)
    segments = max(1, math.ceil(rows.count() / SEGMENT))

    def code(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("vector").combine_chunks(), dimension)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        return pa.table({"segment": t.column("segment")[:1], **{n: pa.array([a.tobytes()], pa.binary()) for n, a in (("ids", ids), ("codes", book.packed(x)), ("vectors", x))}})

    dealt = rows.select("vec_id", "vector", F.pmod(F.xxhash64(F.lit("segment"), "vec_id"), F.lit(segments)).cast("int").alias("segment"))
    return stored(in_groups(dealt.groupBy("segment"), code, "segment int, ids binary, codes binary, vectors binary"), "codes"), book


def _distinct(ids: np.ndarray, codes: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different vectors of a segment, with codes and the k + 1 smallest ids of each (no id: the largest long)."""
    _, first, number = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).reshape(-1), return_index=True, return_inverse=True)
    order = np.lexsort((ids, number))
    number, ids = number[order], ids[order]
    at = np.arange(len(ids)) - np.searchsorted(number, number)
    own = np.full((len(first), min(k + 1, int(at.max()) + 1)), np.iinfo(np.int64).max)
    few = at < own.shape[1]
    own[number[few], at[few]] = ids[few]
    return x[first], codes[first], own


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _scan(tables: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, codes: np.ndarray, own: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best of one segment for a tile of queries."""
    if len(x) > depth:
        total = tables[0].take(codes[:, 0], 0)
        for b in range(1, len(tables)):
            total += tables[b].take(codes[:, b], 0)
        some = np.argpartition(total.T, len(x) - depth, axis=1)[:, len(x) - depth :]
    else:
        some = np.broadcast_to(np.arange(len(x)), (len(queries), len(x)))
    exact = np.einsum("qcd,qd->qc", x[some], queries)
    ids = own[some].reshape(len(queries), -1)
    exact = np.repeat(exact, own.shape[1], axis=1)
    none = (ids == np.iinfo(np.int64).max) | (ids == query_ids[:, None])
    return _best(np.where(none, -np.inf, exact), np.where(none, np.iinfo(np.int64).max, ids), k)


def search(index: DataFrame, book: Codebook, queries: DataFrame, k: int = K, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vector)."""
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    segments = (index.agg(F.max("segment")).first()[0] or 0) + 1
    per = max(1, min(SEGMENTS, segments * blocks // (4 * partitions(index.sparkSession))))  # few enough cells to be large, enough for all cores
    columns = math.ceil(segments / per)

    def scan(t: pa.Table, asked: pa.Table) -> pa.Table:
        if not t.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        asked = asked.combine_chunks()
        ids, q = asked.column("vec_id").to_numpy(), _matrix(asked.column("vector").combine_chunks(), book.dimension)
        score, near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for row in zip(*(t.column(c) for c in ("ids", "codes", "vectors"))):
            own, codes, x = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, (np.int64, np.uint8, np.float64)))
            x, codes, own = _distinct(own, codes.reshape(len(own), -1), x.reshape(-1, book.dimension), k)
            for at in range(0, len(ids), _TILE):
                s = slice(at, at + _TILE)
                more = _scan(book.tables(q[s]), q[s], ids[s], x, codes, own, k, depth)
                score[s], near[s] = _best(np.concatenate([score[s], more[0]], 1), np.concatenate([near[s], more[1]], 1), k)
        of, at = np.nonzero(score > -np.inf)
        return pa.Table.from_arrays([pa.array(ids[of]), pa.array(near[of, at]), pa.array(score[of, at])], schema=_FOUND)

    stock = index.withColumn("x", F.floor(F.col("segment") / per).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(blocks)).cast("int")
    asked = queries.select("vec_id", "vector", block.alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    found = in_groups(stock.groupBy("x", "y").cogroup(asked.groupBy("x", "y")), scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dimension = vectors(read(spark, sf_dir, "embeddings"))
    rows = stored(rows.repartition(partitions(spark), "vec_id"), "vectors")
    index, book = build_index(rows, dimension)
    return search(index, book, rows.where(F.col("vec_id") % EVERY == 0))

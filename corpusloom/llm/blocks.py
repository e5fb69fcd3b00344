"""Documents in blocks of bounded size, and packed hash lists that blocks and hash ranges send each other.

A block's list to a range of hashes is one row, sorted, without repeats; so a hash that a third of
all documents hold is sent once by each block and never gathers in one place.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import note, partitions
from corpusloom.llm.words import U64

#: Bytes of text in a block, about.
BLOCK_BYTES = 2 << 20
#: Buckets of a table, below the most that Spark allows unless told otherwise.
MOST_BUCKETS = 65_536


def planes(a: np.ndarray) -> bytes:
    """The bytes of numbers, most alike together, so that a shuffle compresses them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def numbers(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes by their steps."""
    return planes(np.diff(h, prepend=U64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(numbers(b, np.uint64), dtype=np.uint64)


def ranges(h: np.ndarray, parts: int, place=None) -> Iterator[tuple[int, slice]]:
    """The non-empty ranges of sorted hashes, or the places of ranges, in time that grows with the hashes and not with the ranges."""
    if not len(h):
        return
    of = (h >> U64(32)) * U64(parts) >> U64(32)
    of = of.astype(np.int64) if place is None else place(of.astype(np.int64))
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(h)]
    for a, z in zip(cuts, cuts[1:]):
        yield int(of[a]), slice(a, z)


def buckets_for(blocks: int, partitions: int) -> int:
    """Some blocks a bucket. Spark has a most of buckets; where there are more blocks, a task takes more of them, one after another."""
    return max(1, min(blocks, max(partitions, math.ceil(blocks / 4)), MOST_BUCKETS))


class Blocks:
    """docs as a bucketed table with the columns block, seq (doc_id, nulls last) and those of docs."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        self.count = max(1, math.ceil((size or 0) / BLOCK_BYTES), math.ceil(rows / 50_000))
        buckets = buckets_for(self.count, partitions(self.spark))
        #: Ranges of hashes: a range gets what about one block's text gives, however many blocks there are.
        self.parts = self.count
        self.name = f"corpusloom_blocks_{uuid.uuid4().hex}"
        placed = docs.withColumn("seq", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("seq", "text"), F.lit(self.count)).cast("int"))
        placed.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").format("parquet").saveAsTable(self.name)
        note(self.name)
        self.table = self.spark.table(self.name)

"""Rows on their way to Python: batches of bounded bytes, and memory that goes back when a task ends."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes, about, that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_BYTES, and not only of a bounded number; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in spark.conf.get(name) if c in "-0123456789"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@functools.lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    found = ctypes.CDLL(None)
    return found if hasattr(found, "malloc_trim") else None


def give_back() -> None:
    """Returns what is free to the system; a reused worker would hold it through all later stages."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, in batches of bounded bytes; what a task frees goes back to the system as it ends."""
    bound_batches(df.sparkSession)

    def with_end(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(with_end, schema)

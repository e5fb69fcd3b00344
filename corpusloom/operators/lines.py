"""Lines that may matter, found in Arrow's memory: texts are split and searched by batches, and only few lines come back.

An automaton looks at each byte of a text once, whatever the number of words; no line is a row before it has been found.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from corpusloom.functions.prefilter import ANYTHING
from corpusloom.sources.batches import in_batches


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of texts without their line breaks, as operators.scan.lines_of has them; the text of each and its number in it (from 1). Null has none."""
    parts = pc.split_pattern(texts, "\n")
    lines, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    number = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) + 1
    return lines, of, number.astype(np.int32)


def matches(lines: pa.Array, pattern: str) -> np.ndarray:
    """Where an RE2 pattern occurs; nowhere in null. Lines that RE2 can't read, being no UTF-8, may all match."""
    if pattern == ANYTHING:
        return np.ones(len(lines), bool)
    found = pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    try:
        lines.validate(full=True)
    except pa.ArrowInvalid:
        return np.ones(len(lines), bool)
    return found


def _lists(rows: np.ndarray) -> pa.Array:
    """Of each row of truth values the numbers of the true columns."""
    offsets = np.concatenate([[0], np.cumsum(rows.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(rows)[1].astype(np.int32)))


def found_lines(files: DataFrame, some: str, each: Sequence[str]) -> DataFrame:
    """The other columns of files, line_number (from 1), line (with its line break) and may: of each line where the RE2 pattern some occurs, the numbers of the patterns of each that do, if there are any.

    files has content.
    """
    rest = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, of, number = split_lines(batch.column(len(rest)))
            whole = pc.binary_join_element_wise(lines, pa.scalar("\n"), "")
            last = np.ones(len(of), bool)
            last[:-1] = of[1:] != of[:-1]
            at = np.flatnonzero(matches(whole, some) & ~(last & (pc.binary_length(lines).to_numpy(zero_copy_only=False) == 0)))
            hit = whole.take(pa.array(at))
            rows = np.stack([matches(hit, p) for p in each], 1) if len(at) else np.zeros((0, len(each)), bool)
            kept = rows.any(1)
            at, rows = at[kept], rows[kept]
            line = pc.if_else(pa.array(last[at]), lines.take(pa.array(at)), whole.take(pa.array(at)))
            columns = [batch.column(i).take(pa.array(of[at])) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number[at]), line, _lists(rows)], names=[*rest, "line_number", "line", "may"])

    schema = StructType([files.schema[c] for c in rest]).add("line_number", IntegerType()).add("line", StringType()).add("may", ArrayType(IntegerType()))
    return in_batches(files.select(*rest, "content"), run, schema)


def literal(words: Sequence[str]) -> str:
    """An RE2 pattern that occurs where one of some words does."""
    return "|".join("".join(f"\\x{{{ord(c):x}}}" for c in w) for w in words)


def distinct_lines(files: DataFrame) -> DataFrame:
    """text: the different lines of files (content) without their line breaks; each task sends on a line once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, of, _ = split_lines(batch.column(0))
            last = np.ones(len(of), bool)
            last[:-1] = of[1:] != of[:-1]
            nothing = last & (pc.binary_length(lines).to_numpy(zero_copy_only=False) == 0)
            yield pa.RecordBatch.from_arrays([pc.unique(lines.filter(pa.array(~nothing)))], names=["text"])

    return in_batches(files.select("content"), run, "text string").distinct()


def bits(texts: pa.Array) -> np.ndarray:
    """functions.text.entropy of texts: one sort of all their characters."""
    data = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "")[0].as_buffer().to_pybytes()
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != size.sum():  # bytes that are no UTF-8
        size = np.array([len(x.as_buffer().to_pybytes().decode("utf-8", "replace")) for x in texts], np.int64)
        points = np.frombuffer("".join(x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in texts).encode("utf-32-le"), np.uint32)
    keys = np.repeat(np.arange(len(size)), size) << 21 | points
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    of = keys[first] >> 21
    shares = np.diff(first, append=len(keys)) / size[of]
    return np.bincount(of, -shares * np.log2(shares), len(size))


def with_entropy(rows: DataFrame) -> DataFrame:
    """rows (text) and their entropy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits(batch.column(0)), pa.float64())], names=["text", "entropy"])

    return in_batches(rows.select("text"), run, "text string, entropy double")

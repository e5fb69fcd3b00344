"""Vectorised word splitting and hashing over the bytes of Arrow string columns.

Everything here works on one bounded chunk of whole texts inside a task; Spark
partitions and shuffles the rows. Hashes are 64-bit and depend on content only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are hashed together; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes from which a word is long.
LONG = 256


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


_BYTE = _constants(7, 256)
_BASE = int(_constants(11, 1)[0]) & ~7 | 3
_STEP = int(_constants(13, 1)[0]) & ~7 | 3


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer chunk comes; those for a text far beyond a chunk are not kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 2 * CHUNK_BYTES:
            return self._first(n)
        if len(self.up) < n:
            self.up, self.down = self._first(max(n, min(2 * len(self.up), CHUNK_BYTES), 1 << 16))
        return self.up[:n], self.down[:n]

    def _first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for x in (self.base, self.inverse):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)

#: Words of white-space-separated text: everything but the space and \x09-\x0D.
NOT_SPACE = np.array([not (c == 0x20 or 0x09 <= c <= 0x0D) for c in range(256)])
#: Words of letters, digits and everything beyond ASCII.
ALNUM = np.array([c > 0x7F or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in range(256)])
#: Lower-cases A-Z and leaves every other byte.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; other salts give other, independent orders."""
    h = h + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as the empty text."""
    a = batch.column(batch.schema.get_field_index(name))
    a = pc.fill_null(a.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most limit bytes together, but one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class Words:
    """The words of some whole texts: starts and ends in bytes, text number, 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, fold: bool = False):
        self.base = int(offsets[0])
        offsets = offsets - self.base
        b = data[self.base : self.base + int(offsets[-1])]
        self.bytes = FOLD[b] if fold else b
        n = len(b)
        inside = kind[b]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | first[1:n]
        end[:-1] &= ~inside[1:] | first[1:n]
        self.offsets, self.texts = offsets, len(offsets) - 1
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, its first word
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.texts), self.counts)
        up, down = _BYTES.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[:n], out=total[1:])
        self._total, self._down = total, down
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        self._long(self.bytes)

    def _long(self, raw: np.ndarray) -> None:
        """Long words have hashes of another kind: with polynomials modulo 2**64, words of a thousand bytes and more can be made to collide."""
        for i in np.flatnonzero(self.end - self.start >= LONG):
            self.hash[i] = int.from_bytes(blake2b(raw[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of bytes, not yet mixed."""
        return (self._total[end] - self._total[start]) * self._down[start]

    def grams(self, k: int, salt: int = 0, tokens: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all runs of k words; those that cross into another text are not valid."""
        return grams(self.hash if tokens is None else tokens, k, salt)

    def within(self, k: int) -> np.ndarray:
        """True where the run of k words that begins there stays in its text."""
        n = len(self.text) - k + 1
        return self.text[: max(n, 0)] == self.text[k - 1 :] if n > 0 else np.zeros(0, bool)


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((mix(h, salt) if salt else h) * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n], salt + 1)


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's LONG."""
    return h.view(np.int64)


def texts_of(iterator, *names: str, kind: np.ndarray = NOT_SPACE, fold: bool = False):
    """For each bounded chunk of a mapInArrow input: its rows and its words."""
    for batch in iterator:
        data, offsets = column(batch, names[0] if names else "text")
        for a, z in chunks(offsets):
            yield batch.slice(a, z - a), Words(data, offsets[a : z + 1], kind, fold)

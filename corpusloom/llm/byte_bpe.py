"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

The model has one piece for each rank: the token's bytes, each as one printable
character, scored by the negative rank, with identity normalisation. So sentencepiece
merges the pair of lowest rank first, leftmost of equals, as byte-level BPE asks.
A pre-token that is itself in the vocabulary is that token. Ids are ranks.

``encode`` adds ``ids`` (little-endian unsigned 32-bit integers), ``decode`` adds
``decoded`` (bytes) by the inverse mapping. Both work on whole texts, chunk by chunk;
a task keeps the ids of at most CACHE earlier pre-tokens of at most KEPT characters each, in two generations.

Defined results: null and empty texts have no ids and decode to no bytes; other columns
pass through, and an older ``ids`` or ``decoded`` column is replaced; repeated
rows are encoded each.
"""

from __future__ import annotations

import base64
import codecs
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusloom.llm.tables import in_batches, read
from corpusloom.llm.words import chunks, column

_ID = struct.Struct("<I")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens, about, whose ids a task keeps in each of two generations, and their longest.
CACHE, KEPT = 50_000, 48


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; ids are ranks, the unknown piece follows the last."""
    shown = byte_characters()
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must run from 0 without gaps")
    out = [_field(1, _field(1, "".join(shown[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in pieces]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Coder:
    """Encodes and decodes; one for each task."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(self.ranks))
        # \s is Unicode's White_Space here
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.shown = "".join(byte_characters())
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; pre-tokens that are new to the task are encoded together."""
        found = [self.find(t) for t in texts]
        if len(self.kept) >= CACHE:
            self.older, self.kept = self.kept, {}
        kept, merge, long = self.kept, [], []
        for token in set().union(*found).difference(kept):
            known = self.older.get(token)
            if known is None and (rank := self.ranks.get(token.encode())) is not None:
                known = _ID.pack(rank)
            if known is None:
                merge.append(token)
            else:
                kept[token] = known
        shown = [codecs.charmap_decode(t.encode(), "strict", self.shown)[0] for t in merge]
        for token, ids in zip(merge, self.model.encode(shown, num_threads=1)):
            kept[token] = struct.pack(f"<{len(ids)}I", *ids)
            if len(token) > KEPT:
                long.append(token)
        out = [b"".join(map(kept.__getitem__, f)) for f in found]
        for token in long:
            del kept[token]
        return out

    def decode(self, ids: bytes) -> bytes:
        n = np.frombuffer(ids, "<u4")
        sizes = self.sizes[n]
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[n] - (ends - sizes), sizes)].tobytes()


def _with(df: DataFrame, names: list[str], left_out: str | None, path: str, pattern: str, add) -> DataFrame:
    """df with the binary columns that add makes with a coder, chunk by chunk, from each batch, and without one column."""
    df = df.drop(*names)
    kept = [c for c in df.columns if c != left_out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        for batch in batches:
            for part, made in add(coder, batch):
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in made)], [*kept, *names])

    return in_batches(df, run, StructType([*(f for f in df.schema.fields if f.name in kept), *(StructField(n, BinaryType()) for n in names)]))


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep_text: bool = True, with_decoded: bool = False) -> DataFrame:
    """docs with ids; with_decoded: and, from the same pass, what these ids decode to; the text may be left out."""
    path, pattern = vocabulary or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def add(coder: Coder, batch: pa.RecordBatch):
        data, offsets = column(batch, text)
        raw = memoryview(data)
        for a, z in chunks(offsets):
            ids = coder.encode([str(raw[offsets[i] : offsets[i + 1]], "utf-8", "replace") for i in range(a, z)])
            yield batch.slice(a, z - a), [ids, list(map(coder.decode, ids))] if with_decoded else [ids]

    return _with(docs, ["ids", "decoded"] if with_decoded else ["ids"], None if keep_text else text, path, pattern, add)


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded (with ids) and decoded."""
    path, pattern = vocabulary or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def add(coder: Coder, batch: pa.RecordBatch):
        ids = batch.column(batch.schema.get_field_index("ids"))
        step = 256
        for a in range(0, len(ids), step):
            yield batch.slice(a, step), [[coder.decode(x or b"") for x in ids.slice(a, step).to_pylist()]]

    return _with(encoded, ["decoded"], None, path, pattern, add)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, keep_text=False, with_decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

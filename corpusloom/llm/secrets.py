"""Secrets in texts: three patterns, and strings that a tokenizer can't shorten.

A vocabulary learnt on text has long tokens for what people write and short ones for what they don't: prose has four characters
a token and more, random letters and digits less than two. So each run of the characters that keys are made of is
encoded, and what has fewer than RATIO characters a token is reported, unless it is something known that looks the same: a digest (hexadecimal, of the length
that a known hash function gives), a UUID, a plain number, or an identifier, whose parts between marks, digits and
capitals are words of some length.

The patterns' own spans stay whatever the method says of them; the method adds spans of kind ``random``, none of which lies within one of the others.

Defined results: null and empty texts have no spans; repeated rows are searched each; other columns are ignored; an empty table gives no
rows; of a very long run each PIECE characters are encoded by themselves, so that the work grows with its length. Spans
count code points, their ends are exclusive, and they stand by start, then by kind in the order of KINDS.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.tables import in_batches, read
from corpusloom.llm.words import chunks, column

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
# The patterns of the first three kinds; of an assignment the second group has LEAST_VALUE characters at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
#: One of these is in every assignment.
WORDS = ("passw", "secret", "token", "api")
#: A run that may be random, from LEAST characters on; beyond PIECE it is encoded by pieces.
CANDIDATE, PIECE = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 1_000
#: Characters a token below which a run is random.
RATIO = 2.3
# Lengths of hexadecimal digests of 128, 160, 224, 256, 384 and 512 bits.
DIGESTS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: Parts of an identifier: letters in one case or capitalised; their mean length is WORD or more, and they are PART of it at least.
PARTS, WORD, PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), 3.5, 0.6


@functools.lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """A digest, a UUID, a number or an identifier."""
    if len(run) in DIGESTS and DIGEST.fullmatch(run) or UUID.fullmatch(run) or not any(c.isalpha() for c in run):
        return True
    parts = PARTS.findall(run)
    return sum(map(len, parts)) >= max(WORD * len(parts), PART * len(run))


def ratio(run: str, coder: tiktoken.Encoding) -> float:
    """Characters a token."""
    return len(run) / sum(len(coder.encode_ordinary(run[a : a + PIECE])) for a in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind's number, end of what the three patterns find."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], coder: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """start, kind's number, end of the runs that only the tokenizer tells."""
    out, ends, at = [], 0, 0  # ends: the furthest end of the base spans that begin no later than the run
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            ends, at = max(ends, base[at][2]), at + 1
        if ends < m.end() and not known(m[0]) and ratio(m[0], coder) < RATIO:
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]

    def scan(text: str, coder: tiktoken.Encoding) -> tuple:
        base = base_spans(text)
        more = random_spans(text, base, coder)
        counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
        return *counts, sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)), len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for batch in batches:
            data, offsets = column(batch, "text")
            raw = memoryview(data)
            for a, z in chunks(offsets):
                rows = [scan(str(raw[offsets[i] : offsets[i + 1]], "utf-8", "replace"), coder) for i in range(a, z)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *map(pa.array, zip(*rows), kinds)], names)

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))

"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. A node that a word cannot leave by its next symbol has a failure link to the
node for what is left after popping the longest pieces, and the number of pieces popped
on the way. So each symbol is read once and pieces are counted without being built.

Symbols are bytes, and the last byte of a word is a symbol of its own, as the
vocabulary has pieces that end words; every single symbol is a piece, so every
word has a count. Words are lower-cased runs of letters, single digits, or runs of
other characters that are no white space.

Defined results: null and empty texts have no words and no tokens; repeated rows are
counted each; other columns are ignored. A task keeps the counts of at most CACHE words of at most KEPT characters
each; longer ones are counted whenever they come.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.byte_bpe import byte_characters
from corpusloom.llm.tables import in_batches, read
from corpusloom.llm.words import chunks, column

VOCABULARY = "word_bpe_49k.json"
WORD = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END = "</w>"
CACHE, KEPT = 200_000, 32


def symbols(raw: bytes, ends: bool) -> tuple[int, ...]:
    """Bytes; a word's last one is 256 more."""
    return (*raw[:-1], raw[-1] + 256) if ends else tuple(raw)


def read_pieces(path: str) -> set[tuple[int, ...]]:
    """The pieces of a vocabulary with word ends, as symbols."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    out = set()
    for piece in json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]:
        text = piece.removesuffix(END)
        if text and all(c in byte for c in text):
            out.add(symbols(bytes(byte[c] for c in text), piece.endswith(END)))
    return out


class Automaton:
    """Nodes are numbers, the root is 0; failure -1 means that nothing matches."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: dict[int, int] = {}
        piece, parent = [False], [(0, 0)]
        for p in sorted(pieces):
            at = 0
            for s in p:
                to = self.next.get(at << 9 | s)
                if to is None:
                    to = self.next[at << 9 | s] = len(piece)
                    piece.append(False)
                    parent.append((at, s))
                at = to
            piece[at] = True
        self.failure, self.popped = [-1] * len(piece), [0] * len(piece)
        below: list[list[int]] = [[] for _ in piece]
        for node in range(1, len(piece)):
            below[parent[node][0]].append(node)
        queue = deque(below[0])
        while queue:
            node = queue.popleft()
            queue.extend(below[node])
            if piece[node]:
                self.failure[node], self.popped[node] = 0, 1
                continue
            above, s = parent[node]
            at, n = self.failure[above], self.popped[above]
            while at >= 0 and (at << 9 | s) not in self.next:
                n += self.popped[at]
                at = self.failure[at]
            if at >= 0:
                self.failure[node], self.popped[node] = self.next[at << 9 | s], n

    def count(self, word: tuple[int, ...]) -> int:
        """Pieces of the greedy longest-match split; 0 if there is none."""
        step, failure, popped = self.next, self.failure, self.popped
        at = n = 0
        for s in word:
            while (to := step.get(at << 9 | s)) is None:
                n += popped[at]
                at = failure[at]
                if at < 0:
                    return 0
            at = to
        while at > 0:
            n += popped[at]
            at = failure[at]
        return n if at == 0 else 0


@functools.lru_cache(1)
def _automaton(path: str) -> Automaton:
    return Automaton(read_pieces(path))


class Counter:
    """Word pieces of texts; what it keeps ends with the task."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.find = automaton, regex.compile(WORD).findall
        self.kept: dict[str, int] = {}

    def count(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = self.find(text.lower())
        if len(self.kept) >= CACHE:
            self.kept.clear()
        kept, number = self.kept, self.automaton.count
        new = set(words).difference(kept)
        long = {w for w in new if len(w) > KEPT}
        for w in new - long:
            kept[w] = number(symbols(w.encode(), True))
        if not long:
            return len(words), sum(map(kept.__getitem__, words))
        return len(words), sum(kept[w] if w in kept else number(symbols(w.encode(), True)) for w in words)


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_automaton(path))
        for batch in batches:
            data, offsets = column(batch, "text")
            raw = memoryview(data)
            for a, z in chunks(offsets):
                found = [counter.count(str(raw[offsets[i] : offsets[i + 1]], "utf-8", "replace")) for i in range(a, z)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *(pa.array(x, pa.int64()) for x in zip(*found))], ["doc_id", "n_words", "n_tokens"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))

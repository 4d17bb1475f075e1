"""Byte-level BPE encoding in linear time, and decoding.

Merging pairs in rank order is replaced by a search for the one sequence of tokens that merging would leave: every two
neighbours of it must be compatible, that is, encoding their joined bytes must give these two tokens again. A piece is
read left to right, at each place the longest token first (found for all places at once by an Aho-Corasick automaton
over the bytes, each byte as the Latin-1 character of its number); a token that does not go with its left neighbour
gives way to its next shorter prefix, and where none fits, the place is marked as unreachable and the token before it
is shortened. Each place is marked once, so time is linear in the bytes, also in pieces of millions of bytes.

Two tokens are compatible if undoing merges on both sides of their border, latest first, never meets a pair that would
have been merged across the border earlier. Answers are memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_in_arrow

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pieces of at most so many characters, and so many of them, are remembered with their ids.
SHORT, REMEMBERED = 32, 1 << 18
#: Characters of a text that are split at once; of longer texts, pieces are taken in groups.
SPLIT_CHARS, GROUP = 1 << 20, 1 << 16


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file: base64 and number on each line."""
    return {base64.b64decode(token): int(number) for token, number in map(bytes.split, lines.splitlines())}


class Tokenizer:
    """Encodes and decodes with the given ranks; ids are ranks.

    All 256 single bytes must be tokens and come before all others.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split_at = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        single = [rank for token, rank in ranks.items() if len(token) == 1]
        if len(single) != 256 or max(single) > min((r for t, r in ranks.items() if len(t) > 1), default=1 << 32):
            raise ValueError("the vocabulary must hold all single bytes, before all other tokens")
        self.compatible = lru_cache(1 << 20)(self._compatible)
        self._merges()
        self.automaton = ahocorasick.Automaton()
        # The automaton looks through a node's branches in the order in which they came: frequent tokens have low ranks.
        for token, rank in sorted(ranks.items(), key=lambda item: (len(item[0]) == 1, item[1])):
            if rank in self.halves:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.packed = _Packed(self)

    def _merges(self) -> None:
        """halves: the two tokens that are merged last into a token (a byte: itself twice); merged: the token of two halves.

        shorter: the longest token that a token begins with, else none. A token of several bytes that merging never
        makes has no halves and is only ever a whole piece.
        """
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        for rank, token in sorted(self.bytes_of.items()):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            for end in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:end], rank), self.ranks.get(token[end:], rank)
                if left < rank and right < rank and left in self.halves and right in self.halves and self._compatible(left, right):
                    self.halves[rank], self.merged[left, right] = (left, right), rank
                    break
        for rank, token in self.bytes_of.items():
            prefixes = (self.ranks.get(token[:end]) for end in range(len(token) - 1, 0, -1))
            found = next((p for p in prefixes if p in self.halves), None)
            if found is not None:
                self.shorter[rank] = found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves the two as they are.

        bound: merges from this rank on come after the last one undone, so they cannot have joined the two before it.
        """
        bound = 1 << 32
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            a, b = self.halves[left][1], self.halves[right][0]
            # Undo the later merge of the two; of equal ranks the right one, as merging goes left to right.
            if left > right and a != left:
                bound, left = left, a
            elif b != right:
                bound, right = right + 1, b
            elif a != left:
                bound, left = left, a
            else:
                return True

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends ascend, so the longest one stays
        reachable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else 0
        while at < n:
            end = at + len(self.bytes_of[token])
            if reachable[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end] if end < n else 0
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                reachable[at] = 0
                token = out.pop()
                at -= len(self.bytes_of[token])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the text, 32 bits each, lowest byte first."""
        if len(text) <= SPLIT_CHARS:
            return b"".join(map(self.packed.__getitem__, self.split_at.findall(text)))
        pieces = (m.group() for m in self.split_at.finditer(text))
        groups = iter(lambda: list(islice(pieces, GROUP)), [])
        return b"".join(b"".join(map(self.packed.__getitem__, group)) for group in groups)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Packed(dict):
    """Packed ids of pieces; short ones are remembered, up to a bound."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.tokenizer.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


_built: dict[tuple[bytes, str], Tokenizer] = {}


def _tokenizer(sent: Broadcast, pattern: str) -> Tokenizer:
    """Built once in a worker."""
    key = hashlib.sha256(sent.value).digest(), pattern
    if key not in _built:
        _built.clear()
        _built[key] = Tokenizer(ranks_of(sent.value), pattern)
    return _built[key]


def _mapped(df: DataFrame, source: str, added: dict[str, str], vocabulary: str, pattern: str, values) -> DataFrame:
    """df with the columns `added` (replacing those of these names), from values(tokenizer, binary of column source)."""
    with open(vocabulary, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary: some hundred thousand tokens
    names = {name.lower() for name in added}
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), F.col(f"`{source}`").cast("binary").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent, pattern)
        for batch in batches:
            found = [values(tokenizer, value.as_py() or b"") for value in batch["source"]]
            columns = [pa.array(c, type=pa.int64() if kind == "long" else pa.binary()) for c, kind in zip(zip(*found), added.values())]
            yield pa.RecordBatch.from_arrays([batch["row"], *columns], names=["row", *added])

    schema = rows.select("row").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return map_in_arrow(rows, run, schema).select("row.*", *added)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """docs with ids (binary: 32 bits each, lowest byte first) and n_tokens of the column `text`.

    Each match of the pattern is merged by itself; there are no special tokens. Null counts as empty, which has no
    tokens; bytes that are not UTF-8 are read as U+FFFD. Rows are independent, so repeated rows and ids do not matter.
    Columns named ids or n_tokens are replaced, all others stay. An empty table gives no rows. The vocabulary file is
    read by the driver alone.
    """

    def values(tokenizer: Tokenizer, value: bytes) -> tuple[bytes, int]:
        ids = tokenizer.encode(value.decode("utf-8", "replace"))
        return ids, len(ids) // 4

    return _mapped(docs, text, {"ids": "binary", "n_tokens": "long"}, vocabulary, pattern, values)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the bytes (binary) that the packed ids stand for; null: none.

    An id that the vocabulary lacks is an error. Other columns stay, one named decoded is replaced.
    """
    return _mapped(encoded, ids, {"decoded": "binary"}, vocabulary, PATTERN, lambda tokenizer, value: (tokenizer.decode(value),))

"""Benchmark decontamination: containment search for short items inside long documents.

Words are runs of letters a-z, digits and characters beyond ASCII of the lower-cased text; shingles are five words; an
item with fewer words is one shingle of all of them, and is searched for as a run of that many words. An item is contained when at least `threshold` of its distinct shingles occur in
the document. Items are partitioned by their number of shingles n. The sketch of an item is the k smallest values of
its shingles under one random hash (a bottom-k MinHash), with k set for its size partition such that k exceeds the
number of shingles that a containing document may lack: a document that holds `threshold` of the item must hold at
least k - (n - ceil(threshold * n)) >= 1 values of the sketch, however long it is. So no containment is missed, unlike
with banded signatures, whose collision probability vanishes for long documents. Candidates found by the sketch are
verified by exact shingle containment.

The items are the query set: blocks of bounded size, each broadcast, go over all documents. Documents are not shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_in_arrow, mix64, RollingHash, slices, text_bytes

WORDS = 5
THRESHOLD = 0.8
#: Characters of item texts in one broadcast block.
BLOCK_CHARS = 1 << 23
#: Bytes of document text hashed at once; the hash's tables of powers, which a worker keeps, are as long.
HASHED_BYTES = 1 << 18

_word = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
_hash = RollingHash(seed=8)
_is_word = np.zeros(256, bool)
_is_word[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_is_word[128:] = True


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def shingles_of(words: list[str], width: int = WORDS) -> set[tuple[str, ...]]:
    """Distinct shingles; of a text with fewer words, its whole sequence; of none, none."""
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)}


def needed(n: int, threshold: float = THRESHOLD) -> int:
    """The smallest number of shared shingles of n that reaches the threshold."""
    return max(math.ceil(threshold * n - 1e-9), 1)


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Values in the sketch of an item with n shingles: set for its partition 2^c <= n < 2^(c+1), at most n."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest - needed(largest, threshold) + 1)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of lower-cased UTF-8."""
    buf = np.frombuffer(data, np.uint8)
    flag = np.zeros(len(buf) + 2, np.int8)
    flag[1:-1] = _is_word[buf]
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    value = _hash.of(_hash.prefix(buf), start, end)
    return start, mix64(value + (end - start).astype(np.uint64))


def _combine(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return mix64(out + np.uint64(width))


def _pieces(data: bytes, limit: int = HASHED_BYTES) -> Iterator[bytes]:
    """A long text in pieces that end where a word ends, if there is such a place."""
    start = 0
    while len(data) - start > limit:
        end = start + limit
        while end > start and _is_word[data[end - 1]]:
            end -= 1
        if end == start:
            end = start + limit
            while end < len(data) and _is_word[data[end]]:
                end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def shingle_hashes(texts: list[str | None], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every shingle of the texts, repeats included."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    hashes, owners = [], []
    for lo, hi in slices(data, HASHED_BYTES):
        if hi - lo == 1 and len(data[lo]) > HASHED_BYTES:
            values = np.concatenate([_word_hashes(p)[1] for p in _pieces(data[lo])])
            owner = np.full(len(values), lo)
        else:
            start, values = _word_hashes(b" ".join(data[lo:hi]))
            ends = np.cumsum([len(d) + 1 for d in data[lo:hi]])
            owner = lo + np.searchsorted(ends, start, side="right")
        whole = _combine(values, width)
        same = owner[: len(whole)] == owner[width - 1 :] if len(whole) else np.zeros(0, bool)
        hashes.append(whole[same]), owners.append(owner[: len(whole)][same])
        count = np.bincount(owner - lo, minlength=hi - lo)
        for n in range(1, width):
            for i in np.flatnonzero(count == n):
                first = int(np.searchsorted(owner, lo + i))
                hashes.append(_combine(values[first : first + n], n)), owners.append(np.array([lo + i]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners).astype(np.int64)


class Block:
    """Sketches and shingles of some items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, width: int):
        self.items, self.threshold, self.width = items, threshold, width
        self.sets = [shingles_of(words_of(text), width) for _, text in items]
        values, owners, self.least = [], [], []
        for k, (_, text) in enumerate(items):
            own = np.unique(shingle_hashes([text], width)[0])
            n = len(own)
            size = sketch_size(n, threshold) if n else 0
            self.least.append(size - (n - needed(n, threshold)) if n else 0)
            values.append(np.sort(mix64(own ^ np.uint64(0x5BF03635)))[:size]), owners.append(np.full(size, k))
        value = np.concatenate([np.zeros(0, np.uint64), *values])
        owner = np.concatenate([np.zeros(0, np.int64), *owners]).astype(np.int64)
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], owner[order]
        self.distinct, self.first = np.unique(self.value, return_index=True)
        self.last = np.r_[self.first[1:], len(self.value)].astype(np.int64)
        # Most shingles are told off by a few bits before they are searched for.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.distinct >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(index of the text, index of the item, shingles of the item, shared shingles), verified."""
        if not len(self.distinct):
            return
        hashes, owners = shingle_hashes(texts, self.width)
        hashes = mix64(hashes ^ np.uint64(0x5BF03635))
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.distinct, hashes[maybe]), len(self.distinct) - 1)
        hit = self.distinct[at] == hashes[maybe]
        found: dict[int, dict[int, set[int]]] = {}
        for text, value in zip(owners[maybe[hit]].tolist(), at[hit].tolist()):
            for item in self.owner[self.first[value] : self.last[value]].tolist():
                found.setdefault(text, {}).setdefault(item, set()).add(value)
        for text, items in sorted(found.items()):
            own = None
            for item, values in sorted(items.items()):
                if len(values) >= self.least[item]:
                    own = own if own is not None else shingles_of(words_of(texts[text]), self.width)
                    n, shared = len(self.sets[item]), len(self.sets[item] & own)
                    if shared >= needed(n, self.threshold):
                        yield text, item, n, shared


def blocks_by_width(items: list[tuple[int, str]], threshold: float, width: int) -> list[Block]:
    """Items of fewer words than the width form blocks of their own, whose shingles have as many words."""
    groups: dict[int, list[tuple[int, str]]] = {}
    for item in items:
        groups.setdefault(min(max(len(words_of(item[1])), 1), width), []).append(item)
    return [Block(group, threshold, words) for words, group in sorted(groups.items())]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[Broadcast]:
    """Broadcasts of different (item_id, text) rows, each of about block_chars characters of text, or of one item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(math.ceil(total / block_chars), 1)
    for k in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        yield items.sparkSession.sparkContext.broadcast([tuple(r) for r in part.orderBy("item_id", "text").collect()])


def _repeats(items: DataFrame) -> DataFrame:
    """(of_item, of_text, times): rows of items that repeat an earlier one, times more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = items.groupBy(F.col("item_id").cast("long").alias("of_item"), F.md5(text).alias("of_text")).agg(F.count(F.lit(1)).alias("times"))
    return counts.filter("times > 1")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every row of docs and item that it contains.

    Repeated rows of docs or items give repeated rows. A null or wordless text contains nothing and is contained
    nowhere; rows with null ids take part. No rows for empty tables.
    """
    names = ["doc_id", "item_id", "n_shingles", "n_shared", "containment"]
    schema = pa.schema([(n, pa.int64()) for n in names[:4]] + [(names[4], pa.float64()), ("text_md5", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = blocks_by_width(sent.value, threshold, width)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                found = [(m[0], *block.items[m[1]], m[2], m[3]) for block in blocks for m in block.matches(texts)]
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                columns = [ids, *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 3, 4)), pa.array([f[4] / f[3] for f in found], pa.float64())]
                columns += [pa.array([hashlib.md5(text_bytes(f[2])).hexdigest() for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return map_in_arrow(rows, run, "doc_id long, item_id long, n_shingles long, n_shared long, containment double, text_md5 string")

    found = reduce(DataFrame.unionAll, map(search, _blocks(items, block_chars)))
    same = F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("text_md5") == F.col("of_text"))
    times = F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))
    return found.join(_repeats(items), same, "left").select(*names, F.explode(times).alias("_nth")).drop("_nth")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that contain no item; columns as in docs.

    Every row is judged by its own text, whatever its doc_id: rows that repeat an id, or have none, go or stay by
    themselves. One pass per block of items, without a shuffle. Empty docs give no rows, empty items all rows.
    """
    at = docs.columns.index("text")

    def clean(rows: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = blocks_by_width(sent.value, threshold, width)
            for batch in batches:
                stays, texts = np.ones(len(batch), bool), batch.column(at).to_pylist()
                stays[[m[0] for block in blocks for m in block.matches(texts)]] = False
                yield batch.filter(pa.array(stays))

        return map_in_arrow(rows, run, rows.schema)

    return reduce(clean, _blocks(items, block_chars), docs)

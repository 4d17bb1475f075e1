"""Removal of repeated byte strings: a suffix order limited to the threshold's depth, built by most-significant-digit passes.

A full suffix array would move every position of the corpus. Here a pass moves only what the pass before left in groups
of two or more, and the first digit is read at anchors only: in each window of `threshold` bytes the anchor is the
position whose GRAM bytes have the smallest hash (of equals, the first). Equal windows have equal anchors at equal
places, so no repeat is missed, and about one position in fifty is an anchor.

1. First digit: the GRAM bytes at an anchor. Anchors whose digit occurs once are dropped: no window of theirs repeats.
2. Second digit: all windows of an anchor at once, i.e. the bytes that they cover. Where it is equal for two anchors,
   all their windows repeat; one of them stands for all in the last pass.
3. Last digit: single windows, to the full depth, of the distinct second digits that share a first digit. Equal groups are
   exactly the repeated windows.

All windows of an anchor contain it, so their repeated ones cover one run: from the first such window to the last.
Digits travel as hashes (64 bits where the next digit verifies them, 96 for windows), sorted within partitions by
the first digit and compared with their neighbours. Equal second digits of one batch are settled before the shuffle,
so that copies, however many, do not meet in one partition. Texts are shuffled once, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import joined, map_in_arrow, mix64, RollingHash, written

THRESHOLD = 200
GRAM = 96
#: Bytes handled at once; positions in them take 20 bits.
CHUNK = 1 << 20

_first, _second = RollingHash(seed=2), RollingHash(seed=3)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For the texts buf[start:end] (in order, at most CHUNK bytes in all): arrays (text, anchor, first window, last
    window, first digit, second digit), a row for each anchor; places are offsets in buf.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < threshold:
        return none, none, none, none, none, none
    prefix = _first.prefix(buf)
    grams = mix64(_first.windows(prefix, gram))
    at = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(grams & ~np.uint64(CHUNK - 1) | at, threshold - gram + 1)
    inside = np.zeros(len(buf) + 1, np.int32)
    long = ends - starts >= threshold
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - threshold + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(window):
        return none, none, none, none, none, none
    least = least[window]
    new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    first, last = window[new], window[np.r_[new[1:] - 1, len(window) - 1]]
    anchor = (least[new] & np.uint64(CHUNK - 1)).astype(np.int64)
    # The second digit knows where the anchor lies in it.
    shape = ((last - first) * 1024 + (anchor - first)).astype(np.uint64)
    digit = mix64(_first.of(prefix, first, last + threshold) + mix64(shape))
    text = np.searchsorted(ends, anchor, side="right")
    return text, anchor, first, last, grams[anchor].view(np.int64), digit.view(np.int64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _chunks(offsets: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in chunks: (number of the text, start, end). Long texts go into overlapping parts with disjoint windows."""
    text, start, end, size = [], [], [], 0
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        while hi - lo >= threshold:
            stop = min(hi, lo + CHUNK)
            if size + stop - lo > CHUNK:
                yield np.array(text), np.array(start), np.array(end)
                text, start, end, size = [], [], [], 0
            text.append(i), start.append(lo), end.append(stop)
            size += stop - lo
            if stop == hi:
                break
            lo = stop - threshold + 1
    if text:
        yield np.array(text), np.array(start), np.array(end)


def _bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, bytes): mark, 64 bits of the text and its length, tells rows of equal doc_id and different text apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("mark"), text.cast("binary").alias("bytes"))


def _anchors(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(key, c, doc_id, mark, spot): first and second digit of every anchor.

    spot packs, as few bytes as a shuffle can have, the anchor's first window, the distance of its last one (10 bits) and a
    weight (2 bits). Of equal second digits in a batch, one row has weight 2; the others, weight 0, need no comparison
    and have a key of their own.
    """
    schema = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("spot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            offsets, data = _buffers(batch["bytes"])
            found = [np.zeros((5, 0), np.int64)]
            for text, start, end in _chunks(offsets, threshold):
                buf = np.concatenate([data[a:b] for a, b in zip(start, end)])
                stops = np.cumsum(end - start)
                starts = stops - (end - start)
                of, _, first, last, g, c = anchors_of(buf, starts, stops, threshold, gram)
                found.append(np.array([g, c, text[of], first - starts[of] + start[of] - offsets[text[of]], last - first]))
            g, c, row, place, more = np.concatenate(found, axis=1)
            _, first, back, count = np.unique(c, return_index=True, return_inverse=True, return_counts=True)
            weight = np.zeros(len(c), np.int64)
            weight[first] = np.minimum(count, 2)
            g = np.where(weight > 0, g, mix64((c + place * 31 + batch["mark"].to_numpy()[row]).view(np.uint64)).view(np.int64))
            rows = pa.array(row)
            spot = pa.array(place << 12 | more << 2 | weight)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), batch["doc_id"].take(rows), batch["mark"].take(rows), spot], schema=schema)

    return map_in_arrow(_bytes(docs), run, "key long, c long, doc_id long, mark long, spot long")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, packed): the texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([compress(x) for x in batch["bytes"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], packed], names=["doc_id", "mark", "packed"])

    # The filter drops nothing; with it both joins of the texts have the same input, which is then shuffled once.
    return map_in_arrow(_bytes(docs), run, "doc_id long, mark long, packed binary").filter("mark IS NOT NULL")


def _windows(texts: DataFrame, threshold: int) -> DataFrame:
    """(h1, h2j, c): hash of the j-th window of each of the spots (c, place, more) of texts (doc_id, mark, packed, spots).

    The hash has 96 bits: h1 and the bits of h2j above the lowest 16, which hold j. A merge join brings the rows of one
    text under one id side by side; one of them stands for all, as their windows repeat whole.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2j", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        done = None
        for batch in batches:
            for doc_id, mark, packed, spots in zip(*(batch[k].to_pylist() for k in ("doc_id", "mark", "packed", "spots"))):
                if (doc_id, mark) == done:
                    continue
                done = doc_id, mark
                data = np.frombuffer(unpack(packed), np.uint8)
                for lo in range(0, len(spots), 2048):  # a spot covers fewer than 2 * threshold bytes
                    c, place, more = (np.array([s[k] for s in spots[lo : lo + 2048]]) for k in ("c", "place", "more"))
                    owner = np.repeat(np.arange(len(c)), more + 1)
                    j = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
                    covered = np.concatenate([data[a : a + m + threshold] for a, m in zip(place, more)])
                    at = (np.cumsum(more + threshold) - (more + threshold))[owner] + j
                    h1, h2 = (mix64(r.of(r.prefix(covered), at, at + threshold)) for r in (_first, _second))
                    h2j = (h2 >> np.uint64(32) << np.uint64(16)).view(np.int64) | j
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2j), pa.array(c[owner])], schema=schema)

    return map_in_arrow(texts.select("doc_id", "mark", "packed", "spots"), run, "h1 long, h2j long, c long")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.mark == b.mark)


def _runs(docs: DataFrame, texts: DataFrame, threshold: int, gram: int) -> DataFrame:
    if not gram <= threshold < 1024:
        raise ValueError("gram <= threshold < 1024 must hold")
    by_key = Window.partitionBy("key")
    equal = lambda c, d: F.coalesce(c == d, F.lit(False))
    c, weight = F.col("c"), F.col("spot").bitwiseAND(F.lit(3))
    before, after = F.lag(c).over(by_key.orderBy("c")), F.lead(c).over(by_key.orderBy("c"))
    several = F.min(c).over(by_key) != F.max(c).over(by_key)
    live = (
        _anchors(docs, threshold, gram)
        .select("*", before.alias("before"), after.alias("after"), several.alias("several"))
        .withColumn("whole", (weight != 1) | equal(c, F.col("before")) | equal(c, F.col("after")))
        .withColumn("c", F.when((weight > 0) & F.col("several") & ~equal(c, F.col("before")), c))
        .filter("whole OR c IS NOT NULL")
        .select("c", "doc_id", "mark", F.expr("cast(spot >> 12 AS int)").alias("place"), F.expr("cast(spot >> 2 & 1023 AS int)").alias("more"), "whole")
    )
    # c is null where the anchor takes no part in the last pass.
    live = written(live, "anchors")
    end = F.col("place") + F.col("more") + threshold
    whole = live.filter("whole").select("doc_id", "mark", F.col("place").alias("start"), end.alias("end"))

    spots = live.filter("c IS NOT NULL")
    wanted = spots.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("c", "place", "more")).alias("spots"))
    windows = _windows(texts.join(wanted, _same(texts, wanted)).select(texts.doc_id, texts.mark, "packed", "spots"), threshold)
    order = Window.partitionBy("h1").orderBy("h2j")
    h2 = lambda x: F.shiftright(x, 16)
    again = equal(h2(F.col("h2j")), h2(F.lag("h2j").over(order))) | equal(h2(F.col("h2j")), h2(F.lead("h2j").over(order)))
    j = F.expr("cast(h2j & 65535 AS int)")
    found = windows.withColumn("again", again).filter("again").groupBy("c").agg(F.min(j).alias("lo"), F.max(j).alias("hi"))
    part = spots.filter("NOT whole").join(found, "c")
    part = part.select("doc_id", "mark", (F.col("place") + F.col("lo")).alias("start"), (F.col("place") + F.col("hi") + threshold).alias("end"))
    return whole.unionByName(part)


def repeated_runs(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, start, end): runs of bytes covered by repeated windows of threshold bytes; runs may overlap.

    mark is a hash of the text, for rows that share a doc_id.
    """
    return _runs(docs, _packed(docs), threshold, gram)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    A byte goes if a string of threshold bytes that covers it starts anywhere else too, in this text or another (judged
    on the input). Null text: empty. Repeated rows are texts of their own, so long ones go whole. A null doc_id is an
    id like others. Texts below threshold bytes stay. Empty input gives no rows.
    """
    texts = _packed(docs)
    # Copies of a text under one id have equal spans: as a set, they are bounded by one text.
    spans = _runs(docs, texts, threshold, gram).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            for packed, runs in zip(batch["packed"].to_pylist(), batch["runs"].to_pylist()):
                data = unpack(packed)
                merged: list[list[int]] = []
                for r in sorted((r["start"], r["end"]) for r in runs or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([r[k] for r in out], f.type) for k, f in enumerate(list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], schema=schema)

    joined = texts.join(spans, _same(texts, spans), "left").select(texts.doc_id, "packed", "runs")
    return map_in_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

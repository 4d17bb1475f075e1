"""Near duplicates by SimHash: fingerprints, links by multi-index hashing, components.

Fingerprints of all documents are computed row by row. Equal fingerprints are one class, so exact copies never meet
as pairs. Classes link when their fingerprints differ in few bits; the search cuts a fingerprint into two halves.
Two fingerprints within three bits have a half that differs in one bit at most: each class looks up the ball of
radius one round each of its halves (33 keys) in the table of halves, and complete distances are verified in the
join. Components of the link graph come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_in_arrow, text_bytes, written

#: Hashes whose bits are counted at once.
FLUSH = 1 << 17
HALF = 32


def _shingles(words: list[bytes], width: int, lo: int, hi: int) -> Iterator[bytes]:
    part = words[lo : hi + width - 1]
    return map(b" ".join, zip(*(part[k:] for k in range(width))))


def fingerprints_of(texts: list[str | None], width: int, seed: int) -> np.ndarray:
    """Fingerprint of each text as a signed 64-bit number."""
    counts = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    starts: list[int] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[owners] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        hashes.clear(), owners.clear(), starts.clear()

    for i, text in enumerate(texts):
        words = text_bytes(text).lower().split()
        n = totals[i] = max(len(words) - width + 1, min(len(words), 1))
        if 0 < len(words) < width:
            starts.append(len(hashes)), owners.append(i)
            hashes.append(digest(b" ".join(words), seed))
            n = 0
        for lo in range(0, n, FLUSH):
            starts.append(len(hashes)), owners.append(i)
            hashes += [digest(s, seed) for s in _shingles(words, width, lo, min(n, lo + FLUSH))]
            if len(hashes) >= FLUSH:
                flush()
    flush()
    on = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<i8").ravel()


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of docs; a null or empty text has fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(2).to_pylist(), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], schema=schema)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_in_arrow(rows, run, "doc_id long, text_hash long, fp long")


def links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints fp that differ in 1 to max_bits bits; every pair once."""
    if not 0 <= max_bits <= 3:
        raise ValueError("balls of radius one round both halves find distances up to 3")
    low = (1 << HALF) - 1
    fp = F.col("fp")
    halves = F.array(
        F.struct(F.lit(0).alias("part"), fp.bitwiseAND(F.lit(low)).alias("key")),
        F.struct(F.lit(1).alias("part"), F.shiftrightunsigned(fp, HALF).alias("key")),
    )
    table = classes.select(fp.alias("a"), F.explode(halves).alias("h")).select("a", "h.part", "h.key")
    ball = F.expr("transform(sequence(-1, 31), i -> IF(i < 0, 0L, shiftleft(1L, i)))")
    probes = (
        classes.select(fp.alias("b"), F.explode(halves).alias("h"))
        .select("b", "h.part", "h.key", F.explode(ball).alias("flip"))
        .select("b", "part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    )
    differ = F.col("a").bitwiseXOR(F.col("b"))
    t, p = table.alias("t"), probes.alias("p")
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits)
    on = (F.col("t.part") == F.col("p.part")) & (F.col("t.key") == F.col("p.key"))
    # A pair that both halves find counts for the low half only.
    once = (F.col("t.part") == 0) | (F.bit_count(differ.bitwiseAND(F.lit(low))) > 1)
    # Spark counts the 66 probes of a class as one row, and would broadcast them all by the driver: merged, they are shuffled.
    return t.hint("merge").join(p, on & near & once).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b) with the smallest node that it reaches.

    Each round hangs larger neighbours, then smaller ones, to the smallest neighbour, until the edges are stars.
    Rounds grow with the logarithm of the number of nodes. No group is gathered: only minima by node and joins.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = written(small.filter("u <> v").distinct(), "edges")
        # Both have different rows: counted together, as a join may broadcast stored edges, whose files can be far smaller than the rows.
        stars = new.select("u").distinct().count() == new.count()
        if stars and edges.unionAll(new).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        edges = new


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp, n_links (of its class), component_id, is_kept.

    Fingerprints that differ in max_bits bits or fewer link; component_id is the smallest doc_id reachable, itself
    included (null ids never win; null if a component has no other). is_kept marks the one document that stands for
    its component: of the rows with that doc_id, those with the smallest text_hash. Repeated rows stay; empty input
    gives no rows.
    """
    prints = written(fingerprints(docs, width, seed), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = prints.groupBy("fp").agg(F.min(row).alias("first"))
    pairs = written(links(classes, max_bits), "links")
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    member = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    known = member.join(least, "root").join(degree, "fp", "left").select("fp", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    # Files of stored rows can be far smaller than the rows, which a join could broadcast by that size: merged.
    return prints.hint("merge").join(known, "fp").select("doc_id", "text_hash", "fp", "n_links", F.col("least.doc_id").alias("component_id"), is_kept.alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id; columns as in docs.

    Rows without a doc_id stand for a component only if all its rows have none. Texts that share a doc_id and are no
    near copies of each other stay, each for its own component. Of rows equal in doc_id and text the one whose other
    columns have the smallest hash stays.
    """
    chosen = near_duplicates(docs, width, max_bits, seed).filter("is_kept").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    kept, columns = "__kept", [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias(kept), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    hashed = [f"{kept}.`{f.name}`" for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()]
    return rows.groupBy("doc_id", "hash").agg(F.min_by(kept, F.xxhash64(*hashed)).alias(kept)).select(f"{kept}.*")

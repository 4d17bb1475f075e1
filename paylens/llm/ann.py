"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is indexed by the leaf it descends to. A query walks the tree with
a priority queue: the most promising open node (largest inner product with the node's centre, plus what the spread of
its members can add) is expanded next, and leaves are visited in this order. The number of visited leaves is widened
until the recall on calibration queries, measured against brute force over all vectors, reaches the wanted one.

Equal vectors have equal scores, and ties go to the smaller id: of each distinct vector the k + 1 smallest ids are
candidates and no other row can be in a result. Queries with equal vectors are searched once, for k + 1 neighbours,
and each then leaves itself out. Leaves are cut into pieces of bounded size, and so are the queries that visit a leaf;
each piece returns its best rows per query, which are merged by query. Scores are inner products of the original
vectors in double precision, summed in one fixed order, so equal vectors tie exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import joined, map_in_arrow, send_package, written

SAMPLE = 20_000
BRANCH = 8
LEAF = 64
#: Vectors, and queries, in one piece of a leaf (about; they are dealt by hash).
PIECE = 4096
CALIBRATION = 100
RECALL = 0.97


@dataclass
class Tree:
    """children[n] lists the nodes below n (empty: a leaf); spread is the root mean square distance to the centre."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[np.ndarray]

    @property
    def leaves(self) -> list[int]:
        return [n for n, below in enumerate(self.children) if not len(below)]

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to, by nearest centre."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not len(below) or not len(rows):
                out[rows] = node
                continue
            c = self.centres[below]
            nearest = np.argmax(vectors[rows] @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            todo += [(int(child), rows[nearest == k]) for k, child in enumerate(below)]
        return out

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves of a best-bin-first walk."""
        worth = -(self.centres @ query + np.sqrt(query @ query) * self.spread)
        queue, found = [(float(worth[0]), 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                found.append(node)
            for child in below:
                heapq.heappush(queue, (float(worth[child]), int(child)))
        return found


def grow(sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 9, rounds: int = 8) -> Tree:
    """A tree over the sample; a node of at most `leaf` different vectors is not split."""
    rng = np.random.default_rng(seed)
    centres, spread, children = [], [], []

    def add(rows: np.ndarray) -> int:
        part = sample[rows]
        centre = part.mean(axis=0) if len(rows) else np.zeros(sample.shape[1])
        centres.append(centre)
        spread.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).mean())) if len(rows) else 0.0)
        children.append(np.zeros(0, np.int64))
        return len(centres) - 1

    todo = [(add(np.arange(len(sample))), np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        part = sample[rows]
        different = np.unique(part, axis=0) if len(rows) > leaf else part[:0]
        if len(different) <= max(leaf, branch):
            continue
        c = different[rng.choice(len(different), branch, replace=False)]
        for _ in range(rounds):
            side = np.argmax(part @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            c = np.array([part[side == k].mean(axis=0) if (side == k).any() else c[k] for k in range(branch)])
        groups = [rows[side == k] for k in range(branch) if (side == k).any()]
        if len(groups) > 1:
            below = [add(g) for g in groups]
            children[node] = np.array(below)
            todo += list(zip(below, groups))
    return Tree(np.array(centres), np.array(spread), children)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; the order of the sum does not depend on the other rows."""
    return np.add.reduce(np.ascontiguousarray(vectors * query), axis=1)


def best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best rows, ties by smaller id. rough: scores up to rounding."""
    rows = np.arange(len(rough))
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        rows = np.flatnonzero(rough >= least - 1e-9 * max(1.0, float(np.abs(rough).max())))
    scores = exact_scores(vectors[rows], query)
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, as arrays of doubles. Null ids take no part either."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _neighbours(pairs: DataFrame, rows: DataFrame, dim: int, k: int) -> DataFrame:
    """Best k per (query, piece). pairs: (piece_key, query_id, q); rows: (piece_key, vec_id, v), pieces of bounded size."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        ids = right["vec_id"].combine_chunks().to_numpy()
        vectors = _matrix(right["v"], dim)
        query_ids, queries = left["query_id"].to_numpy(), _matrix(left["q"], dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(queries), 512):
            rough = queries[lo : lo + 512] @ vectors.T
            for j in range(len(rough)):
                found, score = best(ids, vectors, queries[lo + j], rough[j], k)
                out.append((np.full(len(found), query_ids[lo + j]), ids[found], score))
        return pa.table([np.concatenate([o[c] for o in out]) for c in range(3)], schema=schema)

    send_package(pairs.sparkSession)
    found = pairs.groupBy("piece_key").cogroup(rows.groupBy("piece_key"))
    return found.applyInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def search(
    embeddings: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, sample: int = SAMPLE, branch: int = BRANCH, leaf: int = LEAF
) -> DataFrame:
    """For every row of embeddings (vec_id, embedding) for which is_query holds, its k nearest other rows.

    is_query is a condition on vec_id. Returns query_id, rank (from 1), vec_id, score; nearest is the largest inner
    product, ties go to the smaller vec_id. Vectors that are null, zero, or hold a null or non-finite number take no
    part, nor do those whose length is not the most frequent one (of equally frequent lengths, the smaller) or whose id
    is null. Rows that repeat a vec_id count once, with the smallest vector. Fewer candidates than k: all are returned.
    Empty input gives no rows.
    """
    spark = embeddings.sparkSession
    usable = written(valid_vectors(embeddings).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    lengths = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["dim"]
    usable = usable.filter(F.size("v") == dim)

    # A bounded sample, by hash, grows the tree.
    by_hash = F.xxhash64("vec_id", F.lit(9))
    rows = usable.orderBy(by_hash, "vec_id").limit(sample).select("v").toArrow()
    tree = grow(_matrix(rows["v"], dim), branch, leaf)
    sent = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf_of = sent.value.assign(_matrix(batch["v"], dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of)], names=["vec_id", "v", "leaf"])

    def visits(queries: DataFrame, most: int) -> DataFrame:
        """(query_id, leaf, nth) of the first `most` leaves that each of queries (query_id, q) visits."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _matrix(batch["q"], dim)
                for lo in range(0, len(vectors), 64):
                    found = [sent.value.visit(x, most) for x in vectors[lo : lo + 64]]
                    at = pa.array(np.repeat(np.arange(lo, lo + len(found)), [len(f) for f in found]))
                    nth = np.concatenate([np.arange(len(f)) for f in found])
                    columns = [batch["query_id"].take(at), pa.array(np.concatenate(found).astype(np.int64)), pa.array(nth)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "leaf", "nth"])

        return map_in_arrow(queries.select("query_id", "q"), walk, "query_id long, leaf long, nth long")

    equal = Window.partitionBy("v").orderBy("vec_id")
    candidates = usable.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1).select("vec_id", "v")
    index = written(map_in_arrow(candidates, assign, "vec_id long, v array<double>, leaf long"), "index")
    asked = usable.filter(is_query)
    queries = written(asked.groupBy(F.col("v").alias("q")).agg(F.min("vec_id").alias("query_id")), "queries")
    most = calibrate(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION), index, visits, dim, k + 1, recall, len(tree.leaves))

    walks = written(visits(queries, most).select("query_id", "leaf"), "walks")
    split = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias(name))
    pieces = written(split(index, "n_rows").join(split(walks, "n_queries"), "leaf"), "pieces")
    key = F.concat_ws(":", "leaf", "row_piece", "query_piece").alias("piece_key")
    piece = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    members = index.join(pieces, "leaf").withColumn("row_piece", piece("vec_id", "n_rows"))
    members = members.withColumn("query_piece", _upto(F.col("n_queries"))).select(key, "vec_id", "v")
    pairs = walks.join(pieces, "leaf").withColumn("query_piece", piece("query_id", "n_queries"))
    pairs = pairs.withColumn("row_piece", _upto(F.col("n_rows"))).join(queries, "query_id").select(key, "query_id", "q")
    found = written(_top(_neighbours(pairs, members, dim, k + 1), k + 1).select("query_id", "vec_id", "score"), "found")

    # Every asked row takes what its vector found, without itself.
    same = asked.join(queries, F.col("v") == F.col("q")).select(F.col("vec_id").alias("asked_id"), "query_id")
    own = same.join(found, "query_id").filter("vec_id <> asked_id").select(F.col("asked_id").alias("query_id"), "vec_id", "score")
    return _top(own, k).select("query_id", "rank", "vec_id", "score")


def calibrate(queries: DataFrame, index: DataFrame, visits, dim: int, k: int, recall: float, n_leaves: int) -> int:
    """The number of leaves to visit: the smallest at which the given few queries reach the wanted recall.

    They are compared with brute force over the whole index: each batch of it returns its best k with their leaves.
    Their walks over all leaves tell after how many visits each true neighbour is met.
    """
    some = queries.select("query_id", "q").toArrow()
    if not len(some):
        return 1
    sent = index.sparkSession.sparkContext.broadcast((some["query_id"].to_numpy(), _matrix(some["q"], dim)))
    names = ["query_id", "vec_id", "score", "leaf"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = sent.value
        for batch in joined(batches):
            members, rows, leaf = batch["vec_id"].to_numpy(), _matrix(batch["v"], dim), batch["leaf"].to_numpy()
            rough = q @ rows.T
            for j, query_id in enumerate(query_ids.tolist()):
                found, score = best(members, rows, q[j], rough[j], k)
                columns = [np.full(len(found), query_id), members[found], score, leaf[found]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    found = map_in_arrow(index, scan, "query_id long, vec_id long, score double, leaf long")
    nearest = _top(found, k).select("query_id", "leaf").collect()
    nth = {(r[0], r[1]): r[2] for r in visits(queries, n_leaves).collect()}
    met = np.sort([nth[r[0], r[1]] for r in nearest])
    return int(met[min(int(np.ceil(recall * len(met))), len(met)) - 1]) + 1

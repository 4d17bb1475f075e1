"""Centroid clustering in exact integers, with inner products that are kept and only updated.

Every vector keeps its exact inner product with every centroid. When a centroid moves, only the components that changed
count: the change of the inner product is the vector times these changes. Nearest is then the smallest of
|centroid|^2 - 2 * product, as |vector|^2 is the same for all. All of it is integer arithmetic, so rounds of updates
give what a new computation would give, and ties are exact.

A round reads the stored state once to sum the members of each cluster (combined before the shuffle, so one cluster may
hold any share of the rows) and once to write the next state, and then removes the one before. The centroids, a few
thousand numbers, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_in_arrow, removed, stored

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = "2"
#: Integers up to this size keep the squared distance of 64 components within 64 bits.
LARGEST = 1 << 27
#: Vectors whose products are computed at once.
ROWS = 4096
_STATE = "vec_id long, v array<int>, products array<long>, cluster int, distance long"


def integers(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): rows with exactly dim components, none null or non-finite, each component x as floor(scale * x).

    Rows with an integer beyond 2^27 are left out too, since their distances are not whole in 64 bits.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c * scale)
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, by hash, then components; without id: last."""
    by_hash = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select("v", by_hash.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r.v for r in chosen], np.int64)


def means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster's members; an empty cluster's centroid stays."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(before.shape[1])]
    after = before.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)), *sums).collect():
        after[row[0]] = [total // row[1] for total in row[2:]]
    return after


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel(), kind))


def updated(products: np.ndarray, vectors: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """Products after the centroids' changes, from the components that changed."""
    for k, change in enumerate(changes):
        moved = np.flatnonzero(change)
        if len(moved):
            products[:, k] += vectors[:, moved] @ change[moved]
    return products


def _assigned(rows: DataFrame, centroids: np.ndarray, changes: np.ndarray) -> DataFrame:
    """rows (vec_id, v, and products unless the changes start from zero) with products, cluster and distance."""
    kept = "products" in rows.columns
    squares = (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                n = batch.num_rows
                vectors = _matrix(batch["v"], n)
                before = _matrix(batch["products"], n) if kept else np.zeros((n, len(centroids)), np.int64)
                products = updated(before, vectors, changes)
                far = squares - 2 * products
                cluster = far.argmin(axis=1)  # the first, thus smallest, of equal ones
                distance = far[np.arange(n), cluster] + (vectors * vectors).sum(axis=1)
                columns = [batch["vec_id"], batch["v"], _lists(products, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "products", "cluster", "distance"])

    return map_in_arrow(rows.select("vec_id", "v", *["products"] * kept), run, _STATE)


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, products, cluster, distance) of every usable vector of embeddings (vec_id, embedding), and the centroids.

    v holds the integers, products those with every centroid, distance the squared Euclidean one to the nearest
    centroid; equal distances go to the smaller number. Every row is a vector of its own, also where ids repeat or are
    missing; rows without an id are first centroids only if there are too few others. Fewer usable vectors than
    clusters: that many clusters. None: no rows and no centroids. Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = integers(embeddings, dim, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], _STATE), centroids
    read = lambda path: spark.read.schema(_STATE).parquet(path)
    path = stored(_assigned(rows, centroids, centroids), "clusters")
    for _ in range(rounds):
        moved = means(read(path), centroids)
        if (moved == centroids).all():  # no later round changes anything
            break
        last, path = path, stored(_assigned(read(path), moved, moved - centroids), "clusters")
        removed(spark, last)
        centroids = moved
    return read(path), centroids


def report(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of what `cluster` gave.

    Inertia is the sum of distances over the cluster and over all; a sum beyond 64 bits is null.
    """
    spark = members.sparkSession
    # As many rows as there are clusters.
    sums = {r[0]: int(r[1]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    fits = lambda total: total if total < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    whole = fits(sum(sums.values()))
    each = [(k, fits(total), whole, digest(centroids[k])) for k, total in sorted(sums.items())]
    few = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.select("vec_id", "cluster", "distance").join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", *few.columns[1:])

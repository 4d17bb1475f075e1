"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task handles at once; a longer text is handled in pieces.
SLICE_BYTES = 1 << 21
#: Rows and bytes that Spark hands to Python at once, where the session sets no limits of its own: rows hold whole texts.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}
_own_dirs: dict[str, str] = {}
_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let Python workers import this package: once for each application, Spark hands it to the executors."""
    package = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app not in _sent and package.is_dir():
        folder = tempfile.mkdtemp(prefix="package-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    _sent.add(app)


def map_in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    spark = df.sparkSession
    send_package(spark)
    for key, limit in BATCH_LIMITS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, limit)
    return df.mapInArrow(function, schema)


def joined(batches: Iterator[pa.RecordBatch], rows: int = 10_000, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one, up to so many rows and bytes, for work that a larger batch makes smaller."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        if held and (n + batch.num_rows > rows or held_bytes + batch.nbytes > size):
            yield pa.concat_batches(held)
            held, n, held_bytes = [], 0, 0
        held.append(batch)
        n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
    if held:
        yield pa.concat_batches(held)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="run-")
    return _own_dirs[app]


def stored(df: DataFrame, name: str) -> str:
    """Path of the rows of df, stored in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete what `stored` wrote and nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, stored in the shared folder: lineage ends here, and a lost executor loses nothing of it."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most limit bytes together, or one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """Polynomial hashes (mod 2^64, bytes first replaced by random numbers) of substrings of a buffer."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 1):
        self.base = (self.BASE * (2 * seed + 1)) % 2**64
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64((self.base ^ 0xD1B54A32D192ED03) % 2**64 | 1))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 16)
            full = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b % 2**64, np.uint64)], dtype=np.uint64)
            self.power, self.inverse = full(self.base), full(pow(self.base, -1, 2**64))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.power[: len(buf)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of width bytes."""
        n = max(len(prefix) - width, 0)
        return (prefix[width : width + n] - prefix[:n]) * self.inverse[:n]

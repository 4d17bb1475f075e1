"""CSV scan of raw postings."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paylens.model import CSV_COLUMNS, OPTIONAL_COLUMNS, RAW_COLUMNS

#: Headers that are read at the same time.
HEADER_READS = 16


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "NA")
        .option("emptyValue", "")
    )


def _headers(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> dict[tuple[str, ...], list[str]]:
    """Header of each file -> its files. Of a file, a task reads the first line alone; files without any line are left out."""
    files = sorted(spark.read.text(path).inputFiles())

    def header(file: str) -> tuple[str, ...]:
        return tuple(_reader(spark, multi_line).csv(file).columns)

    with ThreadPoolExecutor(HEADER_READS) as pool:
        found = list(pool.map(header, files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, columns in zip(files, found):
        if columns:
            groups.setdefault(columns, []).append(file)
    return groups


def _scan(spark: SparkSession, header: Sequence[str], files: list[str], multi_line: bool) -> DataFrame:
    """The columns we know of files that have the same header."""
    # Columns are assigned by place, which the headers have been found to agree in.
    raw = _reader(spark, multi_line).schema(StructType([StructField(c, StringType()) for c in header])).csv(files)
    known: dict[str, str] = {}
    for column in raw.columns:
        if column in CSV_COLUMNS and CSV_COLUMNS[column] not in known.values():
            known[column] = CSV_COLUMNS[column]
    return raw.select(*[f"`{c}`" for c in known]).withColumnsRenamed(known)


def read_postings_csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Raw postings as text columns with our names; columns we do not use are pruned.

    ``multi_line`` allows line breaks inside quotes and makes a file the unit of
    parallelism. For few, very large files whose text has no line breaks, pass
    ``False`` so that Spark splits the files.

    Files may differ in the order of their columns, lack some, or have others: files
    of equal header are one scan, and scans are joined by name, so that each file is
    read once. What a file lacks is null in its rows. A column that we need must
    be in one file at least; the two that tell where a salary comes from need not.
    If a file names a column twice, in both spellings, the first counts.
    """
    groups = _headers(spark, path, multi_line)
    scans = [_scan(spark, header, files, multi_line) for header, files in groups.items()]
    missing = set(RAW_COLUMNS) - set(OPTIONAL_COLUMNS) - {c for scan in scans for c in scan.columns}
    if missing:
        raise ValueError(f"columns not found in {path}: {sorted(missing)}")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    absent = [c for c in OPTIONAL_COLUMNS if c not in found.columns]
    return found.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else found

"""Where results and cleaned postings are stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.functions.columns import name
from paylens.operators.ranking import borders, places_below

#: Each column of a clustered table is cut into 2**PLACE_BITS ranges.
PLACE_BITS = 5
#: Columns that the filters of postings look at.
CLUSTERED = ("role", "seniority", "sector", "avg_salary")


def write_mart(
    df: DataFrame, path: str, partition_by: Sequence[str] | None = None, sort_by: Sequence[str] | None = None
) -> None:
    """Write a result as Parquet, replacing what the path held.

    Sorting happens within each task, without a shuffle. It narrows the value
    ranges kept per row group, so that later filters on these columns skip data.
    """
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def with_curve_place(df: DataFrame, cols: Sequence[str], out: str, bits: int = PLACE_BITS) -> DataFrame:
    """Place of a row on a space-filling curve over the columns: the bits of its range numbers in turn, highest first.

    Ranges of a column hold about equal numbers of rows (borders from a sample by hash); a null comes before all values.
    """
    bordered = df.withColumns({f"_borders{i}": borders(df, F.col(name(c)), 1 << bits) for i, c in enumerate(cols)})
    ranges = [places_below(F.col(name(c)), F.col(f"_borders{i}")).cast("long") for i, c in enumerate(cols)]
    ranged = bordered.withColumns({f"_range{i}": r for i, r in enumerate(ranges)})
    place = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for i in range(len(cols)):
            place = place * 2 + F.getbit(f"_range{i}", F.lit(bit))
    return ranged.withColumn(out, place).select(*[F.col(name(c)) for c in df.columns], out)


def write_clustered(df: DataFrame, path: str, cols: Sequence[str] = CLUSTERED, files: int = 64, row_group_bytes: int | None = None) -> None:
    """Write a table as Parquet so that a filter on any one of the columns skips most row groups.

    Rows are dealt to files, and sorted within them, by their place on a curve that visits neighbours in all columns
    one after the other. A sort by (role, seniority, salary) serves filters on role only. One shuffle; equal places
    may be split over files, so a hot combination of values does not end in one task.
    """
    spread = F.pmod(F.xxhash64(*[F.col(name(c)) for c in df.columns]), F.lit(1 << 20))
    placed = with_curve_place(df, cols, "_place").withColumn("_spread", spread)
    placed = placed.repartitionByRange(files, "_place", "_spread").sortWithinPartitions("_place", *[F.col(name(c)) for c in cols])
    writer = placed.drop("_place", "_spread").write.mode("overwrite")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

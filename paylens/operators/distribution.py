"""Distribution summaries: box statistics, histograms, two-dimensional counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.columns import name, r6
from paylens.operators.quantiles import grouped_percentiles


def quartiles(rows: DataFrame, keys: Sequence[str], measure: str, method: str = "two_phase", few_groups: bool = False) -> DataFrame:
    wanted = {"q1": (measure, 0.25), "median": (measure, 0.5), "q3": (measure, 0.75)}
    return grouped_percentiles(rows, keys, wanted, method=method, few_groups=few_groups)


def box_columns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box statistics by group of rows that carry ``n`` and quartiles of their group beside their value ``_x``."""
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = F.when(F.col("_x").between(low, high), F.col("_x"))
    outside = (F.col("_x") < low) | (F.col("_x") > high)
    box = rows.groupBy(*map(name, keys), "n", "q1", "median", "q3").agg(
        F.min(inside).alias("_min"), F.max(inside).alias("_max"), F.count_if(outside).alias("n_outliers")
    )
    return box.select(
        *map(name, keys),
        "n",
        *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")],
        r6(F.least("q1", "_min")).alias("whisker_lo"),
        r6(F.greatest("q3", "_max")).alias("whisker_hi"),
        "n_outliers",
    )


def boxes_of(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box statistics from rows and the quartiles of their groups, which are few enough to be broadcast."""
    named = found.select(*[F.col(name(k)).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "q1", "median", "q3")
    same = reduce(Column.__and__, [F.col(name(k)).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return box_columns(rows.join(F.broadcast(named), same), keys)


def box_stats(df: DataFrame, key: str, groups: Sequence[str], measure: str, method: str = "two_phase") -> DataFrame:
    """Quartiles, whiskers and outlier count of ``measure`` for each of ``groups``.

    Whiskers reach to the most extreme values within 1.5 inter-quartile ranges of
    the box and never end inside it. The fences joined back to the rows are one
    row per listed group, so their broadcast has a known size.
    """
    rows = df.select(key, F.col(measure).alias("_x")).where(F.col(key).isin(list(groups)))
    return boxes_of(rows, quartiles(rows, [key], "_x", method, few_groups=True), [key])


def histogram(df: DataFrame, col: str, bins: int, min_n: int) -> DataFrame:
    """Equal-width, right-closed bins: ``bin, x_lo, x_hi, n``, the mean and the total.

    Bin edges lie on odd multiples of half a width. All ``bins`` are listed, also
    empty ones; a column with one distinct value has a single bin. Empty when
    fewer than ``min_n`` rows hold a finite value.
    """
    # Null, NaN and infinite values have no place on the axis.
    values = df.select(F.col(col).cast("double").alias("_x")).where(F.abs("_x") < float("inf"))
    low, high = F.min("_x"), F.max("_x")
    span = values.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg("_x").alias("avg"),
        low.alias("_low"),
        ((high - low) / (bins - 1)).alias("_w"),
    ).where(F.col("total") >= min_n)
    w = F.col("_w")
    origin = F.when(w > 0, w / 2 + F.floor((F.col("_low") - w / 2) / w) * w).otherwise(F.col("_low"))
    span = span.withColumn("_origin", origin)

    grid_of = span.select(F.struct("_origin", "_w")).scalar()
    number = F.ceil((F.col("_x") - grid_of["_origin"]) / grid_of["_w"]) - 1
    placed = F.when(grid_of["_w"] > 0, F.least(F.greatest(number, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = values.groupBy(placed.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = F.when(w > 0, F.lit(bins - 1)).otherwise(F.lit(0)).cast("bigint")
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return grid.join(counts, "bin", "left").select(
        "bin",
        r6(F.col("_origin") + F.col("bin") * w).alias("x_lo"),
        r6(F.col("_origin") + (F.col("bin") + 1) * w).alias("x_hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        r6(F.col("avg")).alias("avg"),
        "total",
    )


def density(df: DataFrame, x: str, x_width: float, y: str, y_width: float, x_out: str, y_out: str) -> DataFrame:
    """Counts on a grid: the lower corner of each non-empty cell and its rows."""

    def corner(col, width):
        # A value on a grid line may come out a hair below it after the division.
        return (F.floor(F.col(col) / width + 1e-9) * width).cast("double")

    return df.groupBy(r6(corner(x, x_width)).alias(x_out), r6(corner(y, y_width)).alias(y_out)).agg(
        F.count(F.lit(1)).alias("n")
    )

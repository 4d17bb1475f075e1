"""Ranking and flags over aggregated results (one row per group, never raw rows).

By default a window without partitions looks at all groups, which is right for results of some thousand rows. With
``large=True`` no task sees more than its share: positions come from ranges of the order, counted and summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.columns import name

#: Ranges that a large result is cut into: COARSE times COARSE; rows that the borders are chosen from.
COARSE = 16
SAMPLE = 16_384


def _order(metric: str, key: str, desc: bool) -> list[Column]:
    by = F.col(metric).desc_nulls_last() if desc else F.col(metric).asc_nulls_last()
    return [by, F.col(key).asc_nulls_last()]


def _sort_key(metric: str, key: str, desc: bool) -> Column:
    """The order as one value that ascends; NaN is above all numbers either way."""
    c = F.col(metric)
    by = [(~F.isnan(c.cast("double"))).alias("b1"), (-c).alias("b2")] if desc else [c.alias("b")]
    return F.struct(c.isNull().alias("a"), *by, F.col(key).isNull().alias("c"), F.col(key).alias("d"))


def _row_hash(df: DataFrame) -> Column:
    """Over all columns, so that each use of ``df`` needs all of them and the shuffles below are shared."""
    return F.xxhash64(*[F.col(name(c)) for c in df.columns])


def borders(df: DataFrame, order: Column, ranges: int) -> Column:
    """Borders of ranges with about equal numbers of rows, as a subquery: evenly spaced in a sample of the rows by hash.

    They depend on the rows alone, so every use of them sees the same ranges. Nulls are left out; no rows, no borders.
    """
    some = df.select(order.alias("_at"), _row_hash(df).alias("_h")).where("_at IS NOT NULL").orderBy("_h", "_at").limit(SAMPLE)
    ordered = some.agg(F.sort_array(F.collect_list("_at")).alias("_all"))
    size = F.size("_all")
    picks = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("_all", F.floor(i * size / ranges).cast("int")))
    return ordered.select(F.when(size > 0, picks).otherwise(F.slice("_all", 1, 0)).alias("_borders")).scalar()


def places_below(value: Column, some: Column) -> Column:
    """How many of the borders lie below the value: the number of its range; 0 for null."""
    return F.size(F.filter(some, lambda b: b < value))


def ordinal(df: DataFrame, metric: str, key: str, desc: bool = False, out: str = "pos", large: bool = False) -> DataFrame:
    """1-based position after sorting on the metric, ties by key.

    ``large``: the rows are dealt to 256 ranges of the order, numbered within their range, and moved on by the rows of
    the ranges before it. ``df`` is used three times; the shuffle that made it is shared.
    """
    if not large:
        order = Window.orderBy(*_order(metric, key, desc))
        return df.withColumn(out, F.row_number().over(order).cast("bigint"))
    at = _sort_key(metric, key, desc)
    # Which range: first among every sixteenth border, then among the fifteen that follow it.
    coarse = F.filter(F.col("_borders"), lambda _, i: (i + 1) % COARSE == 0)
    fine = F.slice("_borders", F.col("_c") * COARSE + 1, COARSE - 1)
    ranged = df.withColumn("_at", at).withColumn("_borders", borders(df, at, COARSE * COARSE)).withColumn("_c", places_below(F.col("_at"), coarse))
    ranged = ranged.withColumn("_range", F.col("_c") * COARSE + places_below(F.col("_at"), fine)).drop("_c", "_borders")
    before = Window.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(F.col("_range").alias("_in")).agg(F.count(F.lit(1)).alias("_size"), F.max(_row_hash(df)).alias("_used"))
    sizes = sizes.where(F.col("_used").isNotNull())  # all; at most 256 rows
    starts = sizes.select("_in", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_at"))
    found = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_in"))
    return found.withColumn(out, (F.col("_start") + place).cast("bigint")).drop("_at", "_range", "_in", "_start")


def top_k(df: DataFrame, metric: str, key: str, k: int, ties: bool = True, large: bool = False) -> DataFrame:
    """The k largest: with all ties of the last one, or exactly k with ties cut by key.

    ``large``: the k-th value comes from each task's best k, and rows are held against it; without ties they are these.
    """
    best = df.orderBy(*_order(metric, key, desc=True)).limit(k) if large else None
    if large and not ties:
        return best
    if large:
        worst = best.agg(F.min_by(F.struct(metric), F.struct(F.col(metric).isNotNull(), metric)).alias("_w")).scalar()
        return df.where(F.when(worst[metric].isNull(), worst.isNotNull()).otherwise(F.coalesce(F.col(metric) >= worst[metric], F.lit(False))))
    if ties:
        place = F.rank().over(Window.orderBy(F.col(metric).desc_nulls_last()))
    else:
        place = F.row_number().over(Window.orderBy(*_order(metric, key, desc=True)))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def flag_max(df: DataFrame, col: str, out: str = "is_top", where: Column | None = None, large: bool = False) -> DataFrame:
    """Does the row hold the largest value, optionally among the rows that meet ``where``?"""
    candidate = F.col(col) if where is None else F.when(where, F.col(col))
    best = df.agg(F.max(candidate).alias("_best")).scalar() if large else F.max(candidate).over(Window.partitionBy())
    return df.withColumn(out, F.coalesce(candidate == best, F.lit(False)))


def highlighted(df: DataFrame, flag: str = "is_top") -> DataFrame:
    """The rows that a flag singles out, all of them where they tie, without the flag; none if none is flagged."""
    return df.where(F.col(flag)).drop(flag)

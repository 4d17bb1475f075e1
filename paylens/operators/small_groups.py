"""Quantiles and box statistics for many groups, of which few are large.

``operators.quantiles`` counts before it shuffles, which pays off when groups are few. With a million companies the
counts are as many as the rows. Here rows are shuffled by key once and sorted by value behind it; ranks are positions in
that order, and all that a group needs is then in one place. Groups of more than ``limit`` rows are told off first by a
count (combined on the map side) and go through the counting operator, which splits a group by ranges of the value: no
task ever sorts more than ``limit`` rows of one group. As a group counts as large only if it holds more than 1 / 10,000
of all rows too, there are at most 10,000 large ones: that bounds the broadcast which separates them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.columns import name
from paylens.operators.distribution import box_columns, boxes_of, quartiles
from paylens.operators.quantiles import grouped_percentiles

LIMIT = 1 << 20
MOST_LARGE = 10_000


def _numbers(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys and measures as doubles; NaN is no value."""
    return df.select(*map(name, keys), *[F.nanvl(F.col(name(c)).cast("double"), F.lit(None)).alias(c) for c in cols])


def split_large(df: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows of small and of large groups."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    total = df.agg(F.count(F.lit(1)).alias("_all")).select(F.col("_all")).scalar()
    large = sizes.where(F.col("_size") > F.greatest(F.lit(limit), total / MOST_LARGE))
    large = F.broadcast(large.select(*[F.col(name(k)).alias(f"_k{i}") for i, k in enumerate(keys)]))
    same = reduce(Column.__and__, [F.col(name(k)).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def _between(low: Column, high: Column, part: Column) -> Column:
    return F.when(low == high, low).otherwise(low * (1 - part) + high * part)


def percentiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], limit: int = LIMIT) -> DataFrame:
    """``keys``, row count ``n`` and one column per wanted ``(column, p)``: what ``grouped_percentiles`` returns."""
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    small, large = split_large(_numbers(df, keys, cols), keys, limit)
    group = Window.partitionBy(*map(name, keys))
    ranked = small
    for i, c in enumerate(cols):  # values first, unknown ones behind them
        ranked = ranked.withColumn(f"_r{i}", F.row_number().over(group.orderBy(F.col(name(c)).asc_nulls_last())) - 1)
    ranked = ranked.withColumns({f"_n{i}": F.count(F.col(name(c))).over(group) for i, c in enumerate(cols)})

    def picked(c: str, p: float) -> Column:
        i = cols.index(c)
        place = (F.col(f"_n{i}") - 1) * p
        at = lambda rank: F.max(F.when(F.col(f"_r{i}") == rank, F.col(name(c))))
        return _between(at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place)))

    found = ranked.groupBy(*map(name, keys)).agg(F.count(F.lit(1)).alias("n"), *[picked(c, p).alias(out) for out, (c, p) in wanted.items()])
    return found.unionByName(grouped_percentiles(large, keys, wanted, few_groups=False))


def boxes(df: DataFrame, keys: Sequence[str], measure: str, limit: int = LIMIT) -> DataFrame:
    """``keys, n``, quartiles, whiskers and number of outliers for each group, as ``box_stats`` has them for listed ones.

    One shuffle of the rows of small groups serves the quartiles, the fences and the rows that are held against them.
    """
    rows = _numbers(df, keys, [measure]).withColumnRenamed(measure, "_x")
    small, large = split_large(rows, keys, limit)
    group = Window.partitionBy(*map(name, keys))
    ranked = small.withColumns({"_r": F.row_number().over(group.orderBy(F.col("_x").asc_nulls_last())) - 1, "_n": F.count("_x").over(group), "n": F.count(F.lit(1)).over(group)})

    def picked(p: float) -> Column:
        place = (F.col("_n") - 1) * p
        at = lambda rank: F.max(F.when(F.col("_r") == rank, F.col("_x"))).over(group)
        return _between(at(F.floor(place)), at(F.ceil(place)), place - F.floor(place))

    fenced = ranked.withColumns({out: picked(p) for out, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))})
    found = box_columns(fenced, keys)
    return found.unionByName(boxes_of(large, quartiles(large, keys, "_x"), keys))

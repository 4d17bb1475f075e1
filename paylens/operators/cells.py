"""Mergeable statistics: rows counted and summed by cell once, then rolled up for every filter and every result.

A cell is a combination of key values, of a measure's grid place among them. Counts and sums of cells add up, so states
of different files or days are merged without reading rows again, and a result over any selection of keys is a sum over
cells. The state has at most as many rows as there are combinations, whatever the number of rows behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.columns import name

ROWS = "n"


def grid_place(measure: Column) -> Column:
    """Even numbers for whole values, odd ones for what lies between: bounds that are whole select places exactly."""
    low = F.floor(measure)
    return 2 * low + F.when(measure > low, 1).otherwise(0)


def within(place: str, lo: float | None, hi: float | None) -> Column:
    """Do the values of a grid place lie between the bounds, both included? Unknown values do not."""
    inside = F.lit(True)
    for bound, meets in ((lo, F.col(place).__ge__), (hi, F.col(place).__le__)):
        if bound is not None:
            if bound != int(bound):
                raise ValueError(f"cells are cut at whole numbers only, not at {bound}")
            inside = inside & meets(2 * int(bound))
    return inside


def summarise(df: DataFrame, keys: Sequence[str], sums: Sequence[str], grid: dict[str, str] | None = None) -> DataFrame:
    """One row per cell: ``keys``, a grid place per ``grid`` (output name to measure), ``n``, and ``sum_m`` and ``n_m``
    of each measure in ``sums`` (over its known values). Combined on the map side, so a hot cell costs no more than others.
    """
    places = {out: grid_place(F.col(name(m)).cast("double")) for out, m in (grid or {}).items()}
    value = lambda m: F.nanvl(F.col(name(m)).cast("double"), F.lit(None))
    added = [c for m in sums for c in (F.sum(value(m)).alias(f"sum_{m}"), F.count(value(m)).alias(f"n_{m}"))]
    return df.withColumns(places).groupBy(*keys, *places).agg(F.count(F.lit(1)).alias(ROWS), *added)


def merged(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all rows behind several states of one layout."""
    first, *others = states
    added = [c for c in first.columns if c == ROWS or c.startswith(("sum_", "n_"))]
    every = first
    for other in others:
        every = every.unionByName(other)
    return every.groupBy(*[c for c in first.columns if c not in added]).agg(*[F.sum(c).alias(c) for c in added])


def rows(where: Column | None = None) -> Column:
    """Number of rows, of cells that meet the condition."""
    return F.coalesce(F.sum(ROWS if where is None else F.when(where, F.col(ROWS))), F.lit(0))


def mean(measure: str, where: Column | None = None) -> Column:
    """Mean of a summed measure, of cells that meet the condition; null without values."""
    total, n = F.col(f"sum_{measure}"), F.col(f"n_{measure}")
    if where is not None:
        total, n = F.when(where, total), F.when(where, n)
    return F.try_divide(F.sum(total), F.sum(n))


def percent(where: Column) -> Column:
    """Percentage of rows that meet the condition, of those for which it is known."""
    return F.try_divide(rows(where) * 100.0, rows(where.isNotNull()))

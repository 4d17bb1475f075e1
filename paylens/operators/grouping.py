"""Group summaries: medians, ranges, shares, category domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.columns import r6
from paylens.operators.quantiles import grouped_percentiles, percentiles_if


def median_by(
    df: DataFrame,
    keys: str | Sequence[str],
    measure: str,
    min_n: int = 0,
    method: str = "two_phase",
    few_groups: bool = False,
) -> DataFrame:
    """``keys, median, n`` for the groups of at least ``min_n`` rows; ``few_groups``: the keys come from fixed lists."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = grouped_percentiles(df, keys, {"median": (measure, 0.5)}, method=method, few_groups=few_groups)
    out = out.where(F.col("n") >= min_n) if min_n else out
    return out.select(*keys, r6(F.col("median")).alias("median"), "n")


def median_if(df: DataFrame, measure: str, populations: Mapping[str, Column], keys: str | Sequence[str] = ()) -> DataFrame:
    """``keys, population, median, n`` of the rows that meet each condition; the conditions may overlap.

    However many there are, it takes the scans of one median. Populations without rows have no result row.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = percentiles_if(df, populations, {"median": (measure, 0.5)}, keys=keys)
    return out.select(*keys, "population", r6(F.col("median")).alias("median"), "n")


def range_by(df: DataFrame, key: str, low: str, mid: str, high: str, method: str = "two_phase", few_groups: bool = False) -> DataFrame:
    """Medians of three measures per group: ``key, lo, mid, hi, n``."""
    wanted = {"lo": (low, 0.5), "mid": (mid, 0.5), "hi": (high, 0.5)}
    out = grouped_percentiles(df, [key], wanted, method=method, few_groups=few_groups)
    return out.select(key, *[r6(F.col(c)).alias(c) for c in wanted], "n")


def share_of_total(df: DataFrame, n: str = "n", large: bool = False) -> DataFrame:
    """Percentage of the column's total, in full and as displayed (one digit); ``large``: for any number of rows."""
    total = df.agg(F.sum(n).alias("_total")).scalar() if large else F.sum(n).over(Window.partitionBy())
    pct = F.col(n) * 100.0 / total
    return df.withColumns({"pct": r6(pct), "pct_1dp": F.bround(pct, 1)})


def share_by(df: DataFrame, key: str) -> DataFrame:
    """``key, n, pct, pct_1dp``."""
    return share_of_total(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")))


def filter_domains(
    df: DataFrame, cols: Mapping[str, tuple[str, str]], fixed: Mapping[str, tuple[str, Sequence[str]]]
) -> DataFrame:
    """Choices offered for each filter: ``domain, value, pos``.

    ``cols`` maps a domain to its column and the choice put in front of the
    sorted distinct values; ``fixed`` maps a domain to that choice and a list of
    values in their own order. One scan serves all columns.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(c).alias("value")) for d, (c, _) in cols.items()])
    # Few combinations remain after a grouping that is combined on the map side; only these are turned into rows.
    combined = df.select(*dict.fromkeys(c for c, _ in cols.values())).distinct()
    found = combined.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    by_value = Window.partitionBy("domain").orderBy("value")
    found = found.withColumn("pos", F.row_number().over(by_value).cast("bigint"))

    rows = [(d, front, 0) for d, (_, front) in cols.items()]
    for d, (front, values) in fixed.items():
        rows += [(d, v, i) for i, v in enumerate([front, *values])]
    listed = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("domain"), F.lit(v).alias("value"), F.lit(i).cast("bigint").alias("pos"))
                for d, v, i in rows
            ]
        )
    )
    literal = df.sparkSession.range(1).select(listed.alias("p")).select("p.*")
    return found.unionByName(literal)

"""Skill demand, premium, co-occurrence and gap. One scan of the rows each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.columns import avg_if, name, r6
from paylens.operators.grouping import median_if
from paylens.sources.skills import with_skill_name


def demand(flag: str) -> Column:
    return F.avg(flag) * 100


def premium(flag: str, measure: str) -> Column:
    """Mean of the measure with the flag minus mean without; null if one side is empty."""
    return avg_if(F.col(flag) == 1, F.col(measure)) - avg_if(F.col(flag) == 0, F.col(measure))


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def _count(where: Column | None = None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count_if(where)


def _mean(measure: str, where: Column | None = None) -> Column:
    return F.avg(measure) if where is None else avg_if(where, F.col(measure))


def _percent(where: Column) -> Column:
    return F.avg(where.cast("double")) * 100


def skill_stats(df: DataFrame, skills: Mapping[str, str], measure: str, rows=_count, demand=demand, premium=premium) -> DataFrame:
    """``skill, skill_pos, demand, premium, n``: one row per skill, also for empty input.

    The aggregates may be given: those of ``operators.cells`` read counts and sums in place of rows.
    """
    one_row = df.agg(
        rows().alias("n"),
        *[demand(s).alias(f"_d_{s}") for s in skills],
        *[premium(s, measure).alias(f"_p_{s}") for s in skills],
    )
    return _rows(
        one_row,
        [
            F.struct(
                F.lit(label).alias("skill"),
                F.lit(i).alias("skill_pos"),
                r6(F.col(f"_d_{s}")).alias("demand"),
                r6(F.col(f"_p_{s}")).alias("premium"),
                F.col("n"),
            )
            for i, (s, label) in enumerate(skills.items(), 1)
        ],
    )


def median_premium(df: DataFrame, skills: Mapping[str, str], measure: str) -> DataFrame:
    """``skill, skill_pos, median_with, median_without, n_with, n_without, premium, n``: one row per skill.

    The premium is the median of the rows with the flag minus that of the rows without; rows whose flag is unknown are
    on neither side. Null if a side is empty. The ten overlapping populations share the scans of one median.
    """
    sides = {f"{s}={side}": F.col(s) == side for s in skills for side in (1, 0)}
    found = median_if(df, measure, {"all": F.lit(True), **sides})
    of = lambda population, c: F.max(F.when(F.col("population") == population, F.col(c)))
    one_row = found.agg(
        F.coalesce(of("all", "n"), F.lit(0)).alias("n"),
        *[of(p, "median").alias(f"_m_{p}") for p in sides],
        *[F.coalesce(of(p, "n"), F.lit(0)).alias(f"_n_{p}") for p in sides],
    )
    column = lambda kind, s, side: F.col(name(f"_{kind}_{s}={side}"))
    return _rows(
        one_row,
        [
            F.struct(
                F.lit(label).alias("skill"),
                F.lit(i).alias("skill_pos"),
                column("m", s, 1).alias("median_with"),
                column("m", s, 0).alias("median_without"),
                column("n", s, 1).alias("n_with"),
                column("n", s, 0).alias("n_without"),
                r6(column("m", s, 1) - column("m", s, 0)).alias("premium"),
                F.col("n"),
            )
            for i, (s, label) in enumerate(skills.items(), 1)
        ],
    )


def demand_by_role(df: DataFrame, key: str, skills: Mapping[str, str], demand=demand) -> DataFrame:
    """Skill demand per group in long form: ``key, skill, pct``."""
    wide = df.groupBy(key).agg(*[r6(demand(s)).alias(s) for s in skills])
    return with_skill_name(wide.unpivot([key], list(skills), "col", "pct")).select(key, "skill", "pct")


def cooccurrence(df: DataFrame, skills: Mapping[str, str], rows=_count, percent=_percent) -> DataFrame:
    """``skill_a, skill_b, pct, n`` for all ordered pairs; each unordered pair is computed once."""
    names = list(skills)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    both = {(a, b): F.bround(percent((F.col(a) == 1) & (F.col(b) == 1)), 0) for a, b in pairs}
    one_row = df.agg(rows().alias("n"), *[c.alias(f"_{a}_{b}") for (a, b), c in both.items()])
    return _rows(
        one_row,
        [
            F.struct(
                F.lit(skills[a]).alias("skill_a"),
                F.lit(skills[b]).alias("skill_b"),
                F.col(f"_{a}_{b}" if (a, b) in both else f"_{b}_{a}").alias("pct"),
                F.col("n"),
            )
            for a in names
            for b in names
        ],
    )


def missing_skills(held: Sequence[str], skills: Mapping[str, str]) -> list[tuple[int, str]]:
    """Position and flag column of each skill that is not held."""
    return [(i, s) for i, s in enumerate(skills, 1) if s not in held]


def skill_gap(
    df: DataFrame, matches: Column, held: Sequence[str], skills: Mapping[str, str], measure: str, min_n: int, rows=_count, mean=_mean
) -> DataFrame:
    """What the postings asking for each missing skill pay above the baseline.

    The baseline is the mean of the matching postings, or of all postings when
    fewer than ``min_n`` match. ``skill, skill_pos, gain, dir, baseline``; no
    rows when all skills are held.
    """
    missing = missing_skills(held, skills)
    one_row = df.agg(
        F.when(rows(matches) >= min_n, mean(measure, matches)).otherwise(mean(measure)).alias("baseline"),
        *[mean(measure, F.col(s) == 1).alias(f"_a_{s}") for s in skills],
    )
    gains = [
        F.struct(
            F.lit(skills[s]).alias("skill"),
            F.lit(i).alias("skill_pos"),
            r6(F.col(f"_a_{s}") - F.col("baseline")).alias("gain"),
            r6(F.col("baseline")).alias("baseline"),
        )
        for i, s in (missing or enumerate(skills, 1))
    ]
    gains = _rows(one_row, gains).withColumn("dir", sign_label(F.col("gain")))
    return gains if missing else gains.where(F.lit(False))


def sign_label(c: Column) -> Column:
    return F.when(c >= 0, "positive").when(c < 0, "negative")

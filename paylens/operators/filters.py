"""The three parameterised filter sets and the population guard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.params import CompanyFilter, PostingFilter, Profile


def select_equal(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows with the wanted values; ``None`` means any."""
    for col, value in wanted.items():
        if value is not None:
            df = df.where(F.col(col) == value)
    return df


def apply_global(df: DataFrame, f: PostingFilter) -> DataFrame:
    if f.lo is not None:
        df = df.where(F.col("avg_salary") >= f.lo)
    if f.hi is not None:
        df = df.where(F.col("avg_salary") <= f.hi)
    return select_equal(df, {"role": f.role, "sector": f.sector, "seniority": f.seniority})


def global_matches(f: PostingFilter) -> Column:
    """The posting filter as one predicate; unknown counts as no match."""
    wanted = {"role": f.role, "sector": f.sector, "seniority": f.seniority}
    terms = [F.col("avg_salary") >= f.lo] * (f.lo is not None) + [F.col("avg_salary") <= f.hi] * (f.hi is not None)
    terms += [F.col(c) == v for c, v in wanted.items() if v is not None]
    return F.coalesce(reduce(lambda a, b: a & b, terms, F.lit(True)), F.lit(False))


def apply_company(df: DataFrame, f: CompanyFilter) -> DataFrame:
    return select_equal(df, {"size": f.size, "ownership": f.ownership})


def profile_matches(p: Profile) -> Column:
    """The profile as one predicate; unknown counts as no match."""
    wanted = {"role": p.role, "job_state": p.state, "seniority": p.seniority}
    terms = [F.col(c) == v for c, v in wanted.items() if v is not None]
    terms += [F.col(skill) == 1 for skill in p.skills]
    return F.coalesce(reduce(lambda a, b: a & b, terms, F.lit(True)), F.lit(False))


def apply_profile(df: DataFrame, p: Profile) -> DataFrame:
    wanted = {"role": p.role, "job_state": p.state, "seniority": p.seniority}
    return select_equal(df, {**wanted, **dict.fromkeys(p.skills, 1)})


def require_rows(df: DataFrame, at_least: int, counted: str = "n") -> DataFrame:
    """Keep a result only if its population, counted in the same aggregate, suffices."""
    return df.where(F.col(counted) >= at_least)

"""From raw postings to cleaned, classified postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens import model as m
from paylens.functions.columns import (
    band_of,
    first_match,
    level_rank,
    null_if_in,
    null_if_negative,
    to_number,
    trim_space,
)


def coerce_numeric(df: DataFrame, cols: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Turn columns into doubles and flags into integers; what is no number becomes null."""
    is_text = {f.name: isinstance(f.dataType, T.StringType) for f in df.schema}
    doubles = {c: to_number(c, is_text[c]) for c in cols}
    return df.withColumns({**doubles, **{c: to_number(c, is_text[c], "int") for c in flags}})


def null_sentinels(df: DataFrame) -> DataFrame:
    """Trim the state and replace the markers of missing values by null."""
    negative = {c: null_if_negative(c) for c in m.MISSING_IF_NEGATIVE}
    text = {c: null_if_in(c, marks) for c, marks in m.MISSING_TEXT.items()}
    return df.withColumns({"job_state": trim_space("job_state"), **negative, **text})


def classify(df: DataFrame, col: str, rules, default: str, out: str) -> DataFrame:
    """Label text by the first rule with a substring in the lower-cased ``col``."""
    lowered = df.withColumn("_text", F.lower(col))
    return lowered.withColumn(out, first_match("_text", rules, default)).drop("_text")


def ordered_domain(df: DataFrame, col: str, levels: Sequence[str], out: str) -> DataFrame:
    """Add the rank of ``col`` in ``levels`` and null values outside the domain."""
    rank = level_rank(col, levels)
    return df.withColumns({out: rank, col: F.when(rank.isNotNull(), F.col(col))})


def band(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, band_of(col, edges, labels))


def locality() -> Column:
    """Is the job in the home state of the company? Unknown stays null."""
    return F.expr(f"CASE WHEN same_state = 1 THEN '{m.LOCAL}' WHEN same_state IS NOT NULL THEN '{m.REMOTE}' END")


def with_locality(df: DataFrame) -> DataFrame:
    return df.withColumn("locality", locality())


def salary_source() -> Column:
    return F.expr(
        f"CASE WHEN employer_provided = 1 THEN '{m.EMPLOYER_CONFIRMED}' "
        f"WHEN hourly = 1 THEN '{m.HOURLY_RATE}' ELSE '{m.ESTIMATED}' END"
    )


def derive(df: DataFrame) -> DataFrame:
    """Add the derived columns; expects nulled sentinels."""
    df = df.withColumn("_title", F.lower("job_title")).withColumns(
        {
            "sal_spread": F.expr("max_salary - min_salary"),
            "role": first_match("_title", m.ROLE_RULES, m.ROLE_DEFAULT),
            "seniority": first_match("_title", m.SENIORITY_RULES, m.SENIORITY_DEFAULT),
            "age_group": band_of("age", m.AGE_EDGES, m.AGE_LEVELS),
            "locality": locality(),
            "sal_source": salary_source(),
        }
    )
    df = df.withColumns(
        {
            "seniority_rank": level_rank("seniority", m.SENIORITY_LEVELS),
            "age_rank": level_rank("age_group", m.AGE_LEVELS),
        }
    )
    return ordered_domain(df.drop("_title"), "size", m.SIZE_LEVELS, "size_rank")


def valid_postings(df: DataFrame) -> DataFrame:
    """Keep postings with a plausible average salary."""
    return df.where(F.col("avg_salary") > m.MIN_VALID_SALARY)


def clean(raw: DataFrame) -> DataFrame:
    """The whole pipeline: numbers, sentinels, validity, derived columns."""
    typed = coerce_numeric(raw.select(*m.RAW_COLUMNS), m.NUMERIC_COLUMNS, m.FLAG_COLUMNS)
    return derive(valid_postings(null_sentinels(typed)))

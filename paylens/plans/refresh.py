"""All counts and means of one refresh from one stored state.

``summary_cells`` reads the postings once; every function here rolls the cells up and returns what the function of the
same name in ``marts`` returns, for any filter whose salary bounds are whole numbers. Store the cells with
``write_mart`` and pass them, read back, as ``source``; states of further postings are added with ``cells.merged``.
``source`` may also be what ``marts`` takes: the cells are then built within the query.
Medians and quantiles are no sums and stay in ``marts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.columns import r6
from paylens.model import SKILLS
from paylens.operators import cells, grouping, skills
from paylens.operators.filters import require_rows, select_equal
from paylens.operators.ranking import flag_max, ordinal, top_k
from paylens.params import PostingFilter, Profile
from paylens.plans import marts

PLACE = "salary_place"
KEYS = ["role", "sector", "seniority", "job_state", "same_state", *SKILLS]
SUMS = [marts.SALARY, "sal_spread"]


def summary_cells(spark, source, params=None) -> DataFrame:
    return cells.summarise(marts.postings(spark, source), KEYS, SUMS, {PLACE: marts.SALARY})


def _cells(spark, source) -> DataFrame:
    if isinstance(source, DataFrame) and PLACE in source.columns:
        return source
    return summary_cells(spark, source)


def _global(spark, source, f: PostingFilter) -> DataFrame:
    kept = _cells(spark, source).where(cells.within(PLACE, f.lo, f.hi))
    return select_equal(kept, {"role": f.role, "sector": f.sector, "seniority": f.seniority})


def _profile(spark, source, p: Profile) -> DataFrame:
    return select_equal(_cells(spark, source), {"role": p.role, "job_state": p.state, "seniority": p.seniority, **dict.fromkeys(p.skills, 1)})


def role_share(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    counts = _global(spark, source, params).groupBy("role").agg(cells.rows().alias("n"))
    return ordinal(flag_max(grouping.share_of_total(counts), "n"), "n", "role")


def busiest_state(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    counts = _global(spark, source, params).groupBy("job_state").agg(cells.rows().alias("n"))
    return top_k(counts, "n", "job_state", 1, ties=False)


def top_states_by_volume(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    counts = _global(spark, source, params).groupBy("job_state").agg(cells.rows().alias("n"))
    return ordinal(flag_max(top_k(counts, "n", "job_state", marts.STATES_SHOWN), "n"), "n", "job_state")


def locality_avg(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    mean = lambda v: r6(cells.mean(marts.SALARY, F.col("same_state") == v))
    return _global(spark, source, params).agg(mean(1).alias("local_avg"), mean(0).alias("remote_avg"))


def _skill_stats(spark, source, params) -> DataFrame:
    salary = marts.SALARY
    return skills.skill_stats(
        _global(spark, source, params),
        SKILLS,
        salary,
        rows=cells.rows,
        demand=lambda s: cells.percent(F.col(s) == 1),
        premium=lambda s, m: cells.mean(m, F.col(s) == 1) - cells.mean(m, F.col(s) == 0),
    )


def skill_demand(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    stats = flag_max(require_rows(_skill_stats(spark, source, params), 1), "demand")
    return ordinal(stats, "demand", "skill_pos").select("skill", "demand", "is_top", "pos")


def skill_premium(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    stats = flag_max(require_rows(_skill_stats(spark, source, params), 1), "premium", "is_best")
    stats = stats.withColumn("dir", skills.sign_label(F.col("premium")))
    return ordinal(stats, "premium", "skill_pos").select("skill", "premium", "dir", "is_best", "pos")


def skill_kpis(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    share = lambda s: r6(cells.percent(F.col(s) == 1))
    return _global(spark, source, params).agg(share("python_yn").alias("python_pct"), share("excel").alias("excel_pct"))


def skill_demand_by_role(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    return skills.demand_by_role(_global(spark, source, params), "role", SKILLS, demand=lambda s: cells.percent(F.col(s) == 1))


def skill_cooccurrence(spark, source, params=marts.ALL_POSTINGS) -> DataFrame:
    g = _global(spark, source, params)
    pairs = require_rows(skills.cooccurrence(g, SKILLS, rows=cells.rows, percent=cells.percent), marts.MIN_FOR_PAIRS)
    return flag_max(pairs, "pct", "is_max", where=F.col("skill_a") != F.col("skill_b")).drop("n")


def profile_top_sectors(spark, source, params=marts.DEFAULT_PROFILE) -> DataFrame:
    known = _profile(spark, source, params).where(F.col("sector").isNotNull())
    counts = known.groupBy("sector").agg(cells.rows().alias("n"))
    return ordinal(top_k(counts, "n", "sector", marts.SECTORS_SHOWN), "n", "sector")


def skill_gap(spark, source, params=marts.DEFAULT_PROFILE) -> DataFrame:
    gaps = skills.skill_gap(
        _cells(spark, source),
        marts.profile_matches(params),
        params.skills,
        SKILLS,
        marts.SALARY,
        marts.MIN_FOR_BASELINE,
        rows=cells.rows,
        mean=cells.mean,
    )
    return ordinal(gaps, "gain", "skill_pos", desc=True).select("skill", "gain", "dir", "baseline", "pos")


MARTS = [
    role_share,
    busiest_state,
    top_states_by_volume,
    locality_avg,
    skill_demand,
    skill_premium,
    skill_kpis,
    skill_demand_by_role,
    skill_cooccurrence,
    profile_top_sectors,
    skill_gap,
]

"""The registered queries: one function per result table.

Every function takes ``(spark, source, params)`` and returns a lazy DataFrame.
``source`` is a directory of star tables, or a DataFrame of cleaned postings:
from ``clean(read_postings_csv(...))``, or read back from where ``write_mart``
stored it, which pays off when many results are wanted from one input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.functions.columns import avg_if, level_rank, or_na, r6, text_round
from paylens.model import AGE_LEVELS, LOCAL, LOCALITIES, REMOTE, SENIORITY_LEVELS, SIZE_LEVELS, SKILLS
from paylens.operators import cleaning, distribution, grouping, itemsets, regression, skills, small_groups
from paylens.operators.filters import (
    apply_company,
    apply_global,
    apply_profile,
    global_matches,
    profile_matches,
    require_rows,
)
from paylens.operators.quantiles import grouped_percentiles, percentiles_if
from paylens.operators.ranking import flag_max, highlighted, ordinal, top_k
from paylens.params import CompanyFilter, PostingFilter, Profile
from paylens.sources.star import postings_from_star

ALL_POSTINGS = PostingFilter()
ALL_COMPANIES = CompanyFilter()
DEFAULT_PROFILE = Profile(role="Data Scientist", skills=("python_yn",))

SALARY = "avg_salary"
MIN_PER_STATE = 3
MIN_PER_OWNERSHIP = 5
MIN_FOR_PAIRS = 10
MIN_FOR_RATING = 6
MIN_FOR_HISTOGRAM = 5
MIN_FOR_BASELINE = 3
STATES_SHOWN = 15
SECTORS_SHOWN = 8
HISTOGRAM_BINS = 20
BAND_POINTS = 80
MIN_SHARED = 2
SKILL_PROFILES = {"analyst": ["Python", "Excel"], "engineer": ["Python", "Spark", "AWS"], "all": list(SKILLS.values())}


def postings(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Cleaned postings."""
    if isinstance(source, DataFrame):
        return source
    return cleaning.clean(postings_from_star(spark, source))


def _global(spark, source, f: PostingFilter) -> DataFrame:
    return apply_global(postings(spark, source), f)


def _company(spark, source, f: CompanyFilter) -> DataFrame:
    return apply_company(postings(spark, source), f)


def _profile(spark, source, p: Profile) -> DataFrame:
    return apply_profile(postings(spark, source), p)


# ---------------------------------------------------------------- postings


def clean_postings(spark, source, params=None) -> DataFrame:
    return postings(spark, source)


def filter_domains(spark, source, params=None) -> DataFrame:
    return grouping.filter_domains(
        postings(spark, source),
        {
            "role": ("role", "All"),
            "sector": ("sector", "All"),
            "ownership": ("ownership", "All"),
            "state": ("job_state", "Any"),
            "profile_role": ("role", "Any"),
        },
        {
            "seniority": ("All", SENIORITY_LEVELS),
            "size": ("All", SIZE_LEVELS),
            "profile_seniority": ("Any", SENIORITY_LEVELS),
        },
    )


def salary_source_counts(spark, source, params=None) -> DataFrame:
    return postings(spark, source).groupBy("sal_source").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- salary landscape


def market_kpis(spark, source, params=ALL_POSTINGS) -> DataFrame:
    wanted = {"median": (SALARY, 0.5), "q1": (SALARY, 0.25), "q3": (SALARY, 0.75)}
    totals = {"_spread": "sal_spread", "_spreads": "CAST(sal_spread IS NOT NULL AS bigint)"}
    kpis = grouped_percentiles(_global(spark, source, params), [], wanted, totals)
    avg_spread = F.try_divide("_spread", "_spreads")
    return kpis.select("n", *[r6(F.col(c)).alias(c) for c in wanted], r6(avg_spread).alias("avg_spread"))


def salary_range_by_role(spark, source, params=ALL_POSTINGS) -> DataFrame:
    g = _global(spark, source, params)
    return ordinal(grouping.range_by(g, "role", "min_salary", SALARY, "max_salary", few_groups=True), "mid", "role")


def top_role(spark, source, params=ALL_POSTINGS) -> DataFrame:
    g = _global(spark, source, params)
    ranges = grouping.range_by(g, "role", "min_salary", SALARY, "max_salary", few_groups=True)
    return top_k(ranges, "mid", "role", 1, ties=False).select("role", "mid", "hi")


def role_share(spark, source, params=ALL_POSTINGS) -> DataFrame:
    shares = grouping.share_by(_global(spark, source, params), "role")
    return ordinal(flag_max(shares, "n"), "n", "role")


def seniority_share(spark, source, params=ALL_POSTINGS) -> DataFrame:
    medians = grouping.median_by(_global(spark, source, params), "seniority", SALARY, few_groups=True)
    rank = level_rank("seniority", SENIORITY_LEVELS).cast("bigint")
    return grouping.share_of_total(medians).withColumn("seniority_rank", rank)


def seniority_median(spark, source, params=ALL_POSTINGS) -> DataFrame:
    return grouping.median_by(_global(spark, source, params), "seniority", SALARY, few_groups=True).drop("n")


def salary_box_by_seniority(spark, source, params=ALL_POSTINGS) -> DataFrame:
    return distribution.box_stats(_global(spark, source, params), "seniority", SENIORITY_LEVELS, SALARY)


# ---------------------------------------------------------------- location


def top_paying_state(spark, source, params=ALL_POSTINGS) -> DataFrame:
    medians = grouping.median_by(_global(spark, source, params), "job_state", SALARY, MIN_PER_STATE)
    return top_k(medians, "median", "job_state", 1, ties=False)


def busiest_state(spark, source, params=ALL_POSTINGS) -> DataFrame:
    counts = _global(spark, source, params).groupBy("job_state").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, "n", "job_state", 1, ties=False)


def _locality_means() -> list[Column]:
    same = F.col("same_state")
    return [
        avg_if(same == 1, F.col(SALARY)).alias("local_avg"),
        avg_if(same == 0, F.col(SALARY)).alias("remote_avg"),
    ]


def locality_avg(spark, source, params=ALL_POSTINGS) -> DataFrame:
    means = _global(spark, source, params).agg(*_locality_means())
    return means.select(*[r6(F.col(c)).alias(c) for c in means.columns])


def top_states_by_volume(spark, source, params=ALL_POSTINGS) -> DataFrame:
    counts = _global(spark, source, params).groupBy("job_state").agg(F.count(F.lit(1)).alias("n"))
    return ordinal(flag_max(top_k(counts, "n", "job_state", STATES_SHOWN), "n"), "n", "job_state")


def top_states_by_salary(spark, source, params=ALL_POSTINGS) -> DataFrame:
    medians = grouping.median_by(_global(spark, source, params), "job_state", SALARY, MIN_PER_STATE)
    top = top_k(medians, "median", "job_state", STATES_SHOWN)
    return ordinal(flag_max(top, "median"), "median", "job_state")


def salary_box_by_locality(spark, source, params=ALL_POSTINGS) -> DataFrame:
    return distribution.box_stats(_global(spark, source, params), "locality", LOCALITIES, SALARY)


def locality_gap(spark, source, params=ALL_POSTINGS) -> DataFrame:
    medians = grouping.median_by(_global(spark, source, params), "locality", SALARY, few_groups=True)
    of = lambda label: F.max(F.when(F.col("locality") == label, F.col("median")))
    both = medians.agg(
        of(LOCAL).alias("local_median"),
        of(REMOTE).alias("remote_median"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    local, remote = F.col("local_median"), F.col("remote_median")
    return require_rows(both, 1).select(
        "local_median",
        "remote_median",
        r6(F.abs(local - remote)).alias("gap"),
        F.bround(F.abs(local - remote), 1).alias("gap_1dp"),
        F.when(local >= remote, "Local").when(local < remote, "Out-of-state").alias("winner"),
    )


def locality_by_role(spark, source, params=ALL_POSTINGS) -> DataFrame:
    return grouping.median_by(_global(spark, source, params), ["role", "locality"], SALARY, few_groups=True).drop("n")


# ---------------------------------------------------------------- skills


def _skill_stats(spark, source, params) -> DataFrame:
    return skills.skill_stats(_global(spark, source, params), SKILLS, SALARY)


def skill_demand(spark, source, params=ALL_POSTINGS) -> DataFrame:
    stats = flag_max(require_rows(_skill_stats(spark, source, params), 1), "demand")
    return ordinal(stats, "demand", "skill_pos").select("skill", "demand", "is_top", "pos")


def skill_premium(spark, source, params=ALL_POSTINGS) -> DataFrame:
    stats = flag_max(require_rows(_skill_stats(spark, source, params), 1), "premium", "is_best")
    stats = stats.withColumn("dir", skills.sign_label(F.col("premium")))
    return ordinal(stats, "premium", "skill_pos").select("skill", "premium", "dir", "is_best", "pos")


def skill_median_premium(spark, source, params=ALL_POSTINGS) -> DataFrame:
    """What the median posting that asks for a skill pays above the median one that does not."""
    found = require_rows(skills.median_premium(_global(spark, source, params), SKILLS, SALARY), 1)
    found = flag_max(found, "premium", "is_best").withColumn("dir", skills.sign_label(F.col("premium")))
    sides = ["median_with", "median_without", "n_with", "n_without"]
    return ordinal(found, "premium", "skill_pos").select("skill", *sides, "premium", "dir", "is_best", "pos")


def top_skill_demand(spark, source, params=ALL_POSTINGS) -> DataFrame:
    stats = _skill_stats(spark, source, params)
    return top_k(stats, "demand", "skill_pos", 1, ties=False).select("skill", "demand")


def top_skill_premium(spark, source, params=ALL_POSTINGS) -> DataFrame:
    stats = _skill_stats(spark, source, params)
    return top_k(stats, "premium", "skill_pos", 1, ties=False).select("skill", "premium")


def skill_kpis(spark, source, params=ALL_POSTINGS) -> DataFrame:
    return _global(spark, source, params).agg(
        r6(skills.demand("python_yn")).alias("python_pct"), r6(skills.demand("excel")).alias("excel_pct")
    )


def skill_demand_highlight(spark, source, params=ALL_POSTINGS) -> DataFrame:
    """The skills in highest demand, ties included."""
    return highlighted(skill_demand(spark, source, params))


def skill_pair_highlight(spark, source, params=ALL_POSTINGS) -> DataFrame:
    """The pairs of different skills that occur together most often."""
    return highlighted(skill_cooccurrence(spark, source, params), "is_max")


def top_states_highlight(spark, source, params=ALL_POSTINGS) -> DataFrame:
    """The states with the most postings, ties included."""
    return highlighted(top_states_by_volume(spark, source, params))


def skill_demand_by_role(spark, source, params=ALL_POSTINGS) -> DataFrame:
    return skills.demand_by_role(_global(spark, source, params), "role", SKILLS)


def skill_cooccurrence(spark, source, params=ALL_POSTINGS) -> DataFrame:
    pairs = require_rows(skills.cooccurrence(_global(spark, source, params), SKILLS), MIN_FOR_PAIRS)
    return flag_max(pairs, "pct", "is_max", where=F.col("skill_a") != F.col("skill_b")).drop("n")


# ---------------------------------------------------------------- companies


def _median_by_level(df: DataFrame, col: str, levels: list[str], rank: str) -> DataFrame:
    known = df.where(F.col(col).isNotNull())
    medians = flag_max(grouping.median_by(known, col, SALARY, few_groups=True), "median", "is_peak")
    return medians.withColumn(rank, level_rank(col, levels).cast("bigint"))


def salary_by_size(spark, source, params=ALL_COMPANIES) -> DataFrame:
    return _median_by_level(_company(spark, source, params), "size", SIZE_LEVELS, "size_rank")


def salary_by_age_group(spark, source, params=ALL_COMPANIES) -> DataFrame:
    return _median_by_level(_company(spark, source, params), "age_group", AGE_LEVELS, "age_rank")


def salary_by_ownership(spark, source, params=ALL_COMPANIES) -> DataFrame:
    known = _company(spark, source, params).where(F.col("ownership").isNotNull())
    medians = grouping.median_by(known, "ownership", SALARY, MIN_PER_OWNERSHIP)
    return ordinal(flag_max(medians, "median"), "median", "ownership")


def _rated(spark, source, params) -> DataFrame:
    return _company(spark, source, params).where(F.col("rating").isNotNull())


def rating_regression(spark, source, params=ALL_COMPANIES) -> DataFrame:
    fit = require_rows(regression.linear_fit(_rated(spark, source, params), SALARY, "rating"), MIN_FOR_RATING)
    named = {"avg_rating": "avg_x", "min_salary": "min_y", "slope": "slope", "intercept": "intercept", "r2": "r2"}
    shown = {"avg_rating_1dp": "avg_x", "slope_1dp": "slope"}
    return fit.select(
        "n",
        *[r6(F.col(c)).alias(out) for out, c in named.items()],
        *[F.bround(F.col(c), 1).alias(out) for out, c in shown.items()],
    )


def rating_fit_band(spark, source, params=ALL_COMPANIES) -> DataFrame:
    band = regression.fit_band(_rated(spark, source, params), SALARY, "rating", BAND_POINTS, MIN_FOR_RATING)
    return band.select(*[r6(F.col(c)).alias(c) for c in band.columns])


def _has_rows(df: DataFrame, at_least: int) -> Column:
    """Does ``df`` have that many rows? The subquery needs all columns of ``df``, so that shuffles below are shared."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns)).alias("used"))
    one = found.select(F.struct("n", "used")).scalar()
    return (one["n"] >= at_least) & one["used"].isNotNull()


def rating_points(spark, source, params=ALL_COMPANIES) -> DataFrame:
    """One row per rated posting: to be written, not collected."""
    rated = _rated(spark, source, params).select("company_name", "rating", SALARY, "role")
    return rated.where(_has_rows(rated, MIN_FOR_RATING))


def rating_density(spark, source, params=ALL_COMPANIES) -> DataFrame:
    rated = _rated(spark, source, params)
    cells = distribution.density(rated, "rating", 0.1, SALARY, 10.0, "rating_bin", "salary_bin")
    counted = cells.withColumn("_rated", F.sum("n").over(Window.partitionBy()))
    return require_rows(counted, MIN_FOR_RATING, "_rated").drop("_rated")


# Results with a row for each of very many keys: no task and no window sees all of them.


def salary_range_by_company(spark, source, params=ALL_POSTINGS) -> DataFrame:
    wanted = {"lo": ("min_salary", 0.5), "mid": (SALARY, 0.5), "hi": ("max_salary", 0.5)}
    found = small_groups.percentiles(_global(spark, source, params), ["company_name"], wanted)
    found = found.select("company_name", *[r6(F.col(c)).alias(c) for c in wanted], "n")
    return ordinal(found, "mid", "company_name", large=True)


def salary_box_by_company(spark, source, params=ALL_POSTINGS) -> DataFrame:
    found = small_groups.boxes(_global(spark, source, params), ["company_name"], SALARY)
    return found.withColumns({w: F.round(w, 2) for w in ("whisker_lo", "whisker_hi")})


def company_share(spark, source, params=ALL_POSTINGS) -> DataFrame:
    counts = _global(spark, source, params).groupBy("company_name").agg(F.count(F.lit(1)).alias("n"))
    flagged = flag_max(grouping.share_of_total(counts, large=True), "n", large=True)
    return ordinal(flagged, "n", "company_name", large=True)


def top_companies(spark, source, params=ALL_POSTINGS) -> DataFrame:
    counts = _global(spark, source, params).groupBy("company_name").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, "n", "company_name", STATES_SHOWN, large=True)


def sector_cooccurrence(spark, source, params=ALL_POSTINGS) -> DataFrame:
    """Sectors for which the same companies hire in the same state, and how often."""
    return itemsets.cooccurrence(_global(spark, source, params), ["company_name", "job_state"], "sector", MIN_SHARED)


def skill_pairs(postings: DataFrame, owners: Sequence[str]) -> DataFrame:
    """``owners, skill`` in long form: a row for each skill that a posting asks for."""
    asked = [F.when(F.col(s) == 1, F.lit(label)) for s, label in SKILLS.items()]
    return postings.select(*owners, F.explode(F.array_compact(F.array(*asked))).alias("skill"))


def skill_profile_holders(spark, source, params=ALL_POSTINGS, profiles=SKILL_PROFILES) -> DataFrame:
    """Companies and sectors whose postings ask for all skills of a profile."""
    owners = ["company_name", "sector"]
    pairs = skill_pairs(_global(spark, source, params), owners)
    # A list inside the plan: no job and no Python worker makes it.
    rows = [F.struct(F.lit(profile).alias("profile"), F.lit(skill).alias("skill")) for profile, held in profiles.items() for skill in held]
    wanted = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    return itemsets.holders(pairs, owners, "skill", wanted, "profile", short=True)


# ---------------------------------------------------------------- profile


def profile_summary(spark, source, params=DEFAULT_PROFILE) -> DataFrame:
    wanted = {"lo": ("min_salary", 0.5), "hi": ("max_salary", 0.5)}
    totals = {"_salary": SALARY, "_salaries": f"CAST({SALARY} IS NOT NULL AS bigint)"}
    found = grouped_percentiles(_profile(spark, source, params), [], wanted, totals)
    avg = F.try_divide("_salary", "_salaries")
    return found.select("n", r6(avg).alias("avg"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


def profile_histogram(spark, source, params=DEFAULT_PROFILE) -> DataFrame:
    return distribution.histogram(_profile(spark, source, params), SALARY, HISTOGRAM_BINS, MIN_FOR_HISTOGRAM)


def profile_top_sectors(spark, source, params=DEFAULT_PROFILE) -> DataFrame:
    known = _profile(spark, source, params).where(F.col("sector").isNotNull())
    counts = known.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return ordinal(top_k(counts, "n", "sector", SECTORS_SHOWN), "n", "sector")


def skill_gap(spark, source, params=DEFAULT_PROFILE) -> DataFrame:
    gaps = skills.skill_gap(
        postings(spark, source), profile_matches(params), params.skills, SKILLS, SALARY, MIN_FOR_BASELINE
    )
    return ordinal(gaps, "gain", "skill_pos", desc=True).select("skill", "gain", "dir", "baseline", "pos")


# ---------------------------------------------------------------- labels


def _labels(one_row: DataFrame, labels: dict[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(k).alias("kpi"), or_na(c).alias("label")) for k, c in labels.items()]
    return one_row.select(F.explode(F.array(*pairs)).alias("_l")).select("_l.*")


def _money(c: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), text_round(c, digits), F.lit("K"))


def kpi_labels(spark, source, params=ALL_POSTINGS, profile=DEFAULT_PROFILE) -> DataFrame:
    """The formatted headline texts; a text without data reads ``N/A``.

    The market and the profile are two populations of one quantile; the means of the market are one more scan.
    """
    c = F.col
    range_text = lambda low, high: F.concat(_money(low), F.lit(" – "), _money(high))
    with_note = lambda name, note: F.concat(name, F.lit(" ("), note, F.lit(")"))
    percent = lambda v, digits: F.concat(text_round(v, digits), F.lit("%"))

    wanted = {"q1": (SALARY, 0.25), "median": (SALARY, 0.5), "q3": (SALARY, 0.75), "low": ("min_salary", 0.5), "high": ("max_salary", 0.5)}
    populations = {"market": global_matches(params), "profile": profile_matches(profile)}
    totals = {f"_s_{m}": m for m in ("sal_spread", SALARY)} | {f"_c_{m}": f"CAST({m} IS NOT NULL AS bigint)" for m in ("sal_spread", SALARY)}
    both = percentiles_if(postings(spark, source), populations, wanted, totals)
    of = lambda population, column: F.max(F.when(c("population") == population, column))
    mean = lambda m: r6(F.try_divide(f"_s_{m}", f"_c_{m}"))
    found = both.agg(
        *[F.coalesce(of(p, c("n")), F.lit(0)).alias(f"n_{p}") for p in populations],
        *[of("market", r6(c(q))).alias(q) for q in ("q1", "median", "q3")],
        *[of("profile", r6(c(q))).alias(q) for q in ("low", "high")],
        of("market", mean("sal_spread")).alias("avg_spread"),
        of("profile", mean(SALARY)).alias("avg"),
    )
    quantiles = _labels(
        found,
        {
            "postings": F.format_number("n_market", 0),
            "median_salary": _money(c("median"), 1),
            "middle_half": range_text(c("q1"), c("q3")),
            "avg_spread": _money(c("avg_spread"), 1),
            "profile_matches": F.format_number("n_profile", 0),
            "profile_avg": _money(c("avg"), 1),
            "profile_range": range_text(c("low"), c("high")),
        },
    )

    def best(values):
        ranked = [F.struct(r6(c(f"{values}_{s}")).alias("v"), F.lit(-i).alias("order"), F.lit(label).alias("skill")) for i, (s, label) in enumerate(SKILLS.items())]
        return F.array_max(F.array(*ranked))

    g = _global(spark, source, params)
    one_row = g.agg(
        *_locality_means(),
        *[skills.demand(s).alias(f"demand_{s}") for s in SKILLS],
        *[skills.premium(s, SALARY).alias(f"premium_{s}") for s in SKILLS],
    ).withColumns({"top": best("demand"), "prized": best("premium")})
    means = _labels(
        one_row,
        {
            "local_avg": _money(c("local_avg"), 1),
            "remote_avg": _money(c("remote_avg"), 1),
            "top_skill_demand": with_note(c("top.skill"), F.concat(percent(c("top.v"), 0), F.lit(" of jobs"))),
            "top_skill_premium": with_note(c("prized.skill"), F.concat(F.lit("+"), _money(c("prized.v"), 1))),
            "python_share": percent(c("demand_python_yn"), 1),
            "excel_share": percent(c("demand_excel"), 1),
        },
    )

    # The smallest (descending metric, null flag, state) is the winner of top_k(..., 1).
    state_key = [c("job_state").isNull().alias("unknown"), c("job_state").alias("state")]
    enough = c("n") >= MIN_PER_STATE
    states = grouping.median_by(g, "job_state", SALARY).agg(
        F.min(F.when(enough, F.struct((-c("median")).alias("m"), *state_key))).alias("paying"),
        F.min(F.struct((-c("n")).alias("m"), *state_key)).alias("busy"),
    )
    states = _labels(
        states,
        {
            # A winner whose state is unknown is a winner, unlike none at all.
            "top_paying_state": with_note(F.when(c("paying.unknown"), "NA").otherwise(c("paying.state")), _money(-c("paying.m"))),
            "busiest_state": with_note(F.when(c("busy.unknown"), "NA").otherwise(c("busy.state")), F.concat((-c("busy.m")).cast("string"), F.lit(" jobs"))),
        },
    )
    return quantiles.unionByName(states).unionByName(means)


def salary_quantiles_two_phase(spark, source, params=ALL_POSTINGS) -> DataFrame:
    wanted = {"q1": (SALARY, 0.25), "median": (SALARY, 0.5), "q3": (SALARY, 0.75)}
    found = grouped_percentiles(_global(spark, source, params), ["role"], wanted, method="two_phase", few_groups=True)
    return found.select("role", *[r6(F.col(q)).alias(q) for q in wanted])

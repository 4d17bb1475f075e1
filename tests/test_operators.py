"""Operators on small inputs with answers worked out by hand or by brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens import model as m
from paylens.operators import distribution, filters, grouping, ranking, regression, skills
from paylens.operators.quantiles import grouped_percentiles, two_phase_percentile
from paylens.params import CompanyFilter, PostingFilter, Profile
from paylens.sources.sinks import read_mart, write_mart

PS = {"q1": ("x", 0.25), "median": ("x", 0.5), "q3": ("x", 0.75), "lo": ("x", 0.0), "hi": ("x", 1.0)}


def frame(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "k string, x double")


def check_quantiles(spark, groups, levels):
    found = {r["k"]: r for r in grouped_percentiles(frame(spark, groups), ["k"], PS, levels=levels).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        known = [v for v in values if v is not None]
        assert found[k]["n"] == len(values)
        for out, (_, p) in PS.items():
            want = float(np.quantile(known, p)) if known else None
            assert found[k][out] == (pytest.approx(want, rel=1e-12, abs=1e-300) if known else None), (k, out)


def test_quantiles_by_hand(spark):
    df = frame(spark, {"a": [1.0, 2.0, 4.0, 10.0]})
    out = two_phase_percentile(df, "k", "x", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()[0]
    assert (out["a"], out["b"], out["c"]) == (1.75, 3.0, 5.5)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_quantiles_of_all_shapes(spark, levels):
    rng = random.Random(7)
    check_quantiles(
        spark,
        {
            "one": [3.5],
            "two": [1.0, 2.0],
            "same": [5.0] * 9,
            "null key": [1.0, None, 3.0],
            "all null": [None, None],
            None: [7.0, 8.0, 9.5],
            "signs": [-4.0, -0.5, 0.0, -0.0, 2.0, 1e-9, -1e-9],
            "wide": [1e-300, 1e300, -1e300, 1.0],
            "close": [100 + i * 1e-9 for i in range(500)],
            "normal": [rng.gauss(100, 30) for _ in range(2000)],
            "negative": [rng.gauss(-100, 30) for _ in range(999)],
            "ties": [float(rng.randint(1, 5)) for _ in range(1000)],
            "skew": [rng.paretovariate(1.1) for _ in range(1500)],
        },
        levels,
    )


def test_quantiles_of_infinities(spark):
    inf = float("inf")
    row = grouped_percentiles(frame(spark, {"a": [-inf, 1.0, inf]}), ["k"], PS).collect()[0]
    assert [row[c] for c in ("lo", "q1", "median", "q3", "hi")] == [-inf, -inf, 1.0, inf, inf]


def test_quantiles_when_one_group_holds_most_rows(spark):
    hot = spark.range(200_000).selectExpr("'hot' AS k", "CAST(id * 7919 % 200000 AS double) / 7 AS x")
    cold = spark.range(100).selectExpr("concat('k', id % 50) AS k", "CAST(id AS double) AS x")
    both = hot.unionByName(cold)
    ours = {r["k"]: r for r in grouped_percentiles(both, ["k"], PS).collect()}
    exact = {r["k"]: r for r in grouped_percentiles(both, ["k"], PS, method="exact").collect()}
    assert set(ours) == set(exact) and len(ours) == 51
    for k, row in exact.items():
        assert all(ours[k][c] == pytest.approx(row[c], rel=1e-12) for c in PS)
        assert ours[k]["n"] == row["n"]


def test_quantiles_of_several_measures_and_totals(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0, 10.0), ("a", 1, 2.0, None), ("a", 2, 9.0, 30.0), ("b", None, 4.0, None)],
        "k string, j int, x double, y double",
    )
    out = grouped_percentiles(df, ["k"], {"mx": ("x", 0.5), "my": ("y", 0.5)}, {"s": "x", "c": "1"}).collect()
    assert sorted(tuple(r) for r in out if r["k"] == "a") == [("a", 3, 2.0, 20.0, 12.0, 3)]
    assert [tuple(r) for r in out if r["k"] == "b"] == [("b", 1, 4.0, None, 4.0, 1)]
    two_keys = grouped_percentiles(df, ["k", "j"], {"mx": ("x", 0.5)}).collect()
    assert {(r["k"], r["j"]): (r["n"], r["mx"]) for r in two_keys} == {
        ("a", 1): (2, 1.5),
        ("a", 2): (1, 9.0),
        ("b", None): (1, 4.0),
    }


@pytest.mark.parametrize("wanted", [{"m": ("x", 0.5)}, {"m": ("x", 0.5), "q": ("y", 0.25)}])
def test_quantiles_of_nothing(spark, wanted):
    empty = spark.createDataFrame([], "k string, x double, y double")
    one = grouped_percentiles(empty, [], wanted, {"s": "x"}).collect()
    assert [(r["n"], r["m"], r["s"]) for r in one] == [(0, None, None)]
    assert grouped_percentiles(empty, ["k"], wanted).collect() == []


def test_unknown_method_or_levels(spark):
    df = frame(spark, {"a": [1.0]})
    for wrong in ({"method": "guess"}, {"levels": 4}):
        with pytest.raises(ValueError):
            grouped_percentiles(df, ["k"], PS, **wrong)


def test_levels_by_setting(spark):
    """Close values share a bin; each further level looks into fewer of them."""
    df = frame(spark, {"a": [100 + i * 1e-5 for i in range(5000)]})
    spark.conf.set("spark.paylens.quantile.levels", "2")
    try:
        by_setting = grouped_percentiles(df, ["k"], {"m": ("x", 0.5)})
    finally:
        spark.conf.unset("spark.paylens.quantile.levels")
    assert by_setting.collect()[0]["m"] == pytest.approx(100 + 2499.5e-5, rel=1e-14)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_nan_is_no_value(spark, levels):
    df = frame(spark, {"a": [float("nan"), 1.0, 2.0, 3.0, float("nan")], "b": [float("nan")]})
    wanted = {"lo": ("x", 0.25), "mid": ("x", 0.5), "hi": ("x", 0.75)}
    two = sorted(grouped_percentiles(df, ["k"], wanted, levels=levels).collect())
    assert two == sorted(grouped_percentiles(df, ["k"], wanted, method="exact").collect())
    assert tuple(two[0]) == ("a", 5, 1.5, 2.0, 2.5)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_values_are_windowed_bin_by_bin(spark, keys):
    plan = grouped_percentiles(frame(spark, {"a": [1.0, 2.0]}), keys, {"m": ("x", 0.5)})._jdf.queryExecution()
    windows = [w for w in plan.optimizedPlan().toString().splitlines() if "Window [" in w]
    over_values = [w for w in windows if "_value#" in w.rpartition("], [")[2]]
    assert over_values and all("_bin#" in w.split("], [")[-2] for w in over_values)


def test_quantile_plan_has_no_value_buffer_and_no_python(spark):
    df = frame(spark, {"a": [1.0, 2.0]})
    plan = grouped_percentiles(df, ["k"], PS)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan and "Python" not in plan


def test_median_by_needs_enough_rows(spark):
    df = frame(spark, {"two": [1.0, 2.0], "three": [1.0, 2.0, 4.0]})
    assert [tuple(r) for r in grouping.median_by(df, "k", "x", min_n=3).collect()] == [("three", 2.0, 3)]


def test_ranking(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 4), ("e", None)], "k string, n int")
    assert sorted(r["k"] for r in ranking.top_k(df, "n", "k", 3).collect()) == ["a", "b", "c", "d"]
    assert sorted(r["k"] for r in ranking.top_k(df, "n", "k", 3, ties=False).collect()) == ["a", "b", "c"]
    assert [r["k"] for r in ranking.top_k(df, "n", "k", 1, ties=False).collect()] == ["a"]
    order = {r["k"]: r["pos"] for r in ranking.ordinal(df, "n", "k").collect()}
    assert order == {"c": 1, "d": 2, "a": 3, "b": 4, "e": 5}
    order = {r["k"]: r["pos"] for r in ranking.ordinal(df, "n", "k", desc=True).collect()}
    assert order == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    flags = {r["k"]: r["is_top"] for r in ranking.flag_max(df, "n").collect()}
    assert flags == {"a": True, "b": True, "c": False, "d": False, "e": False}
    flags = {r["k"]: r["is_top"] for r in ranking.flag_max(df, "n", where=F.col("k") > "b").collect()}
    assert flags == {"a": False, "b": False, "c": True, "d": True, "e": False}


def test_shares(spark):
    df = spark.createDataFrame([("a",)] * 1 + [("b",)] * 3 + [(None,)] * 4, "k string")
    shares = {r["k"]: (r["n"], r["pct"], r["pct_1dp"]) for r in grouping.share_by(df, "k").collect()}
    assert shares == {"a": (1, 12.5, 12.5), "b": (3, 37.5, 37.5), None: (4, 50.0, 50.0)}


def test_half_even_display(spark):
    row = spark.range(1).select(F.bround(F.lit(2.5), 0), F.bround(F.lit(3.5), 0), F.bround(F.lit(2.25), 1)).collect()[0]
    assert tuple(row) == (2.0, 4.0, 2.2)


def test_domains(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y")], "p string, q string")
    out = grouping.filter_domains(df, {"p": ("p", "All"), "q": ("q", "Any")}, {"f": ("All", ["z", "y"])})
    assert sorted(tuple(r) for r in out.collect()) == [
        ("f", "All", 0),
        ("f", "y", 2),
        ("f", "z", 1),
        ("p", "All", 0),
        ("p", "a", 1),
        ("p", "b", 2),
        ("q", "Any", 0),
        ("q", "x", 1),
        ("q", "y", 2),
    ]


def test_box(spark):
    groups = {"a": [1.0, 2.0, 3.0, 4.0, 100.0, -50.0], "b": [5.0] * 4, "c": [0.0, 10.0, 10.0, 10.0], "other": [1.0]}
    out = {r["k"]: r for r in distribution.box_stats(frame(spark, groups), "k", ["a", "b", "c"], "x").collect()}
    assert set(out) == {"a", "b", "c"}
    for k, r in out.items():
        x = np.array(groups[k])
        q1, q3 = np.quantile(x, [0.25, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r["whisker_lo"], r["whisker_hi"]) == (min(q1, inside.min()), max(q3, inside.max()))
        assert r["n_outliers"] == len(x) - len(inside)
        assert r["median"] == statistics.median(groups[k])
    assert out["a"]["n_outliers"] == 2
    assert out["c"]["whisker_lo"] == 7.5  # never inside the box, though 0 is an outlier


def test_histogram(spark):
    rng = random.Random(3)
    values = [rng.uniform(20, 200) for _ in range(300)]
    rows = distribution.histogram(frame(spark, {"a": values}), "x", 20, 5).orderBy("bin").collect()
    assert [r["bin"] for r in rows] == list(range(20))
    assert sum(r["n"] for r in rows) == 300 == rows[0]["total"]
    w = (max(values) - min(values)) / 19
    for r in rows:
        assert r["x_hi"] - r["x_lo"] == pytest.approx(w, abs=1e-5)
        assert (r["x_lo"] / w) % 1 == pytest.approx(0.5, abs=1e-4)
        assert r["n"] == sum(r["x_lo"] < v <= r["x_hi"] for v in values)
    assert rows[0]["avg"] == pytest.approx(statistics.mean(values), abs=1e-6)


def test_histogram_edges(spark):
    assert distribution.histogram(frame(spark, {"a": [1.0] * 4}), "x", 20, 5).collect() == []
    same = distribution.histogram(frame(spark, {"a": [7.0] * 5}), "x", 20, 5).collect()
    assert [(r["bin"], r["x_lo"], r["n"]) for r in same] == [(0, 7.0, 5)]
    whole = distribution.histogram(frame(spark, {"a": [float(i) for i in range(20)]}), "x", 20, 5).orderBy("bin")
    assert [r["n"] for r in whole.collect()] == [1] * 20


def test_density(spark):
    df = spark.createDataFrame([(1 + i / 10, 10.0 * i) for i in range(41)], "r double, s double")
    cells = distribution.density(df, "r", 0.1, "s", 10.0, "a", "b").orderBy("a").collect()
    assert [(r["a"], r["b"], r["n"]) for r in cells] == [(round(1 + i / 10, 1), 10.0 * i, 1) for i in range(41)]


FLAGS = {"p": "P", "q": "Q"}


def test_skills(spark):
    df = spark.createDataFrame([(None, 0, 10.0), (None, 1, 20.0), (1, 1, 40.0)], "p int, q int, x double")
    pairs = {(r["skill_a"], r["skill_b"]): r["pct"] for r in skills.cooccurrence(df, FLAGS).collect()}
    assert pairs == {("P", "P"): 100.0, ("Q", "Q"): 67.0, ("P", "Q"): 50.0, ("Q", "P"): 50.0}
    stats = {r["skill"]: (r["demand"], r["premium"], r["n"]) for r in skills.skill_stats(df, FLAGS, "x").collect()}
    assert stats == {"P": (100.0, None, 3), "Q": (pytest.approx(66.666667), 20.0, 3)}


def test_premium_everyone_has_never_wins(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (1, 1, 5.0)], "p int, q int, x double")
    stats = ranking.flag_max(skills.skill_stats(df, FLAGS, "x"), "premium")
    rows = {r["skill"]: (r["premium"], r["is_top"], r["pos"]) for r in ranking.ordinal(stats, "premium", "skill_pos").collect()}
    assert rows == {"Q": (-5.0, True, 1), "P": (None, False, 2)}


@pytest.mark.parametrize("matching, baseline", [(2, 25.0), (3, 20.0)])
def test_gap_baseline(spark, matching, baseline):
    rows = [(1, 0, 10.0, True), (1, 1, 20.0, True), (0, 1, 30.0, matching == 3), (1, 0, 40.0, False)]
    df = spark.createDataFrame(rows, "p int, q int, x double, hit boolean")
    out = skills.skill_gap(df, F.col("hit"), ("p",), FLAGS, "x", 3).collect()
    assert [(r["skill"], r["baseline"], r["gain"]) for r in out] == [("Q", baseline, 25.0 - baseline)]
    assert out[0]["dir"] == "positive"
    assert skills.skill_gap(df, F.col("hit"), ("p", "q"), FLAGS, "x", 3).collect() == []


def test_filters(spark):
    cols = "avg_salary double, role string, sector string, seniority string, size string, ownership string, job_state string, python_yn int"
    rows = [
        (10.0, "a", None, "s", "z", "o", "CA", 1),
        (260.0, "b", "m", "s", None, "o", "CA", 0),
        (260.1, "b", "m", "t", "z", None, "TX", None),
    ]
    df = spark.createDataFrame(rows, cols)
    assert filters.apply_global(df, PostingFilter()).count() == 2
    assert filters.apply_global(df, PostingFilter(sector="m")).count() == 1
    assert filters.apply_global(df, PostingFilter(hi=300, role="b", seniority="t")).count() == 1
    assert filters.apply_company(df, CompanyFilter()).count() == 3
    assert filters.apply_company(df, CompanyFilter(size="z", ownership="o")).count() == 1
    for p in [Profile(), Profile("b"), Profile(state="CA"), Profile(skills=("python_yn",)), Profile(seniority="s", role="a")]:
        assert filters.apply_profile(df, p).count() == df.where(filters.profile_matches(p)).count()
    assert filters.apply_profile(df, Profile(skills=("python_yn",))).count() == 1
    with pytest.raises(ValueError):
        Profile(skills=("cobol",))


def test_regression(spark):
    rng = random.Random(11)
    xs = [rng.uniform(1, 5) for _ in range(40)]
    ys = [50 + 8 * x + rng.gauss(0, 3) for x in xs]
    df = spark.createDataFrame([*zip(xs, ys), (None, 1.0), (2.0, None)], "x double, y double")
    fit = regression.linear_fit(df, "y", "x").collect()[0]
    slope, intercept = np.polyfit(xs, ys, 1)
    assert (fit["n"], fit["slope"], fit["intercept"]) == (40, pytest.approx(slope), pytest.approx(intercept))
    assert fit["r2"] == pytest.approx(np.corrcoef(xs, ys)[0, 1] ** 2)
    assert (fit["min_x"], fit["max_x"], fit["min_y"]) == (min(xs), max(xs), min(ys))

    band = regression.fit_band(df, "y", "x", 80, 6).orderBy("x").collect()
    assert len(band) == 80
    assert (band[0]["x"], band[-1]["x"]) == (pytest.approx(min(xs)), pytest.approx(max(xs)))
    mean, sxx = statistics.mean(xs), sum((x - statistics.mean(xs)) ** 2 for x in xs)
    s = math.sqrt(sum((y - intercept - slope * x) ** 2 for x, y in zip(xs, ys)) / 38)
    t_38 = 2.024394  # table value
    for r in band:
        half = t_38 * s * math.sqrt(1 / 40 + (r["x"] - mean) ** 2 / sxx)
        assert r["fit"] == pytest.approx(intercept + slope * r["x"])
        assert r["ci_hi"] - r["fit"] == pytest.approx(half, rel=1e-4)
        assert r["fit"] - r["ci_lo"] == pytest.approx(half, rel=1e-4)


def test_t_quantile(spark):
    table = {4: 2.776445, 5: 2.570582, 10: 2.228139, 30: 2.042272, 1000: 1.962339}
    for dof, t in table.items():
        got = spark.range(1).select(regression.student_t_975(F.lit(float(dof)))).collect()[0][0]
        assert got == pytest.approx(t, abs=1e-3 if dof < 10 else 2e-5)


def test_band_needs_spread(spark):
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "x double, y double")
    assert regression.fit_band(flat, "y", "x", 80, 6).collect() == []


def test_marts_can_be_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    write_mart(df, str(tmp_path / "plain"))
    write_mart(df, str(tmp_path / "parts"), ["k"])
    for name in ("plain", "parts"):
        back = read_mart(spark, str(tmp_path / name)).select("k", "n")
        assert sorted(tuple(r) for r in back.collect()) == [("a", 1), ("b", 2)]
    assert (tmp_path / "parts" / "k=a").is_dir()


def test_model_is_consistent():
    assert set(m.CSV_COLUMNS.values()) == set(m.RAW_COLUMNS)
    assert len(m.AGE_LEVELS) == len(m.AGE_EDGES) + 1

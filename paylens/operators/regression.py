"""One-variable least squares and its confidence band, from sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the 0.975 quantile of the standard normal distribution.
Z_975 = 1.959963984540054


def student_t_975(dof: Column) -> Column:
    """Quantile of Student's t by the Cornish-Fisher series in 1/dof, four terms."""
    z = Z_975
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return F.lit(z) + g1 / dof + g2 / (dof * dof) + g3 / (dof * dof * dof) + g4 / (dof * dof * dof * dof)


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: ``n, avg_x, min_x, max_x, min_y, slope, intercept, r2, sxx, sxy, syy``."""
    y, x = F.col(y), F.col(x)
    return df.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("avg_x"),
        F.min(F.when(y.isNotNull(), x)).alias("min_x"),
        F.max(F.when(y.isNotNull(), x)).alias("max_x"),
        F.min(F.when(x.isNotNull(), y)).alias("min_y"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    )


def fit_band(df: DataFrame, y: str, x: str, grid: int, min_n: int) -> DataFrame:
    """The fitted line and its 95 % band at ``grid`` evenly spaced points."""
    c = F.col
    fit = linear_fit(df, y, x).where((c("n") >= min_n) & (c("sxx") > 0))
    variance = (c("syy") - c("sxy") * c("sxy") / c("sxx")) / (c("n") - 2)
    fit = fit.withColumns(
        {"_s": F.sqrt(F.greatest(variance, F.lit(0.0))), "_t": student_t_975((c("n") - 2).cast("double"))}
    )
    step = (c("max_x") - c("min_x")) / (grid - 1)
    points = fit.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "x", c("min_x") + c("_i") * step
    )
    away = c("x") - c("avg_x")
    half = c("_t") * c("_s") * F.sqrt(1.0 / c("n") + away * away / c("sxx"))
    line = c("intercept") + c("slope") * c("x")
    return points.select("x", line.alias("fit"), (line - half).alias("ci_lo"), (line + half).alias("ci_hi"))

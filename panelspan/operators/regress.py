"""Straight-line estimators and their robust standard errors.

Every fit is two aggregates: a first pass with the built-in (numerically stable) regression
aggregates, and a residual pass for the robust variance. Nothing but one row per model is ever
collected or sent to Python.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_numeric, positive_part, ratio
from ..functions.dist import t_tail_udf
from ..plans.scale import Series, attach, group_agg, materialise
from ..spec import REGRESSION_SCHEMA, shape_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Z95 = 1.96
TINY_SD = 1e-10


def regression_rows(df: DataFrame, by: Sequence[str], model: str, outcome: str, treatment: str,
                    error: Column, values: dict[str, Column], ci: str = "t") -> DataFrame:
    """Finish ``regression_result`` rows: t, p, interval; numbers are NULL where ``error`` is set."""
    ok = error.isNull()
    base = df.withColumn("_error", error)
    for name in ("estimate", "se", "df"):
        base = base.withColumn(f"_{name}", F.when(ok, values[name]))
    base = base.withColumn("_t", F.when(ok, F.when(F.col("_se") > 0, F.col("_estimate") / F.col("_se"))
                                        .otherwise(F.lit(0.0))))
    base = base.withColumn("_tail", F.when(ok & (F.col("_df") > 0), t_tail_udf(
        F.coalesce("_t", F.lit(0.0)), F.coalesce("_df", F.lit(1.0)))))
    half = F.col("_se") * (F.lit(Z95) if ci == "normal" else F.col("_tail.crit"))
    out = {k: F.when(F.col("_error").isNull(), v) for k, v in values.items()}
    out.update(
        model=F.lit(model), outcome=F.lit(outcome), treatment=F.lit(treatment),
        status=F.when(F.col("_error").isNull(), "ok").otherwise("error"), error=F.col("_error"),
        estimate=F.col("_estimate"), se=F.col("_se"), df=F.col("_df"), t_stat=F.col("_t"),
        pvalue=F.col("_tail.pvalue"), significant=F.col("_tail.pvalue") < 0.05,
        ci_lower=F.col("_estimate") - half, ci_upper=F.col("_estimate") + half,
        n_obs=F.coalesce(values["n_obs"], F.lit(0)))
    return shape_rows(base, REGRESSION_SCHEMA, by, out)


def _carry(*names: str) -> list[Column]:
    return [F.any_value(n).alias(n) for n in names]


def line_stats(f: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """First pass over ``_y`` and ``_x``: size, means and centred sums."""
    return group_agg(
        f, by, F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_my"), F.avg("_x").alias("_mx"),
        F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_sxy("_y", "_x").alias("_sxy"),
        F.regr_syy("_y", "_x").alias("_syy"), *more)


def line_fit(f: DataFrame, by: Sequence[str], *extra: Column) -> DataFrame:
    """Slope, intercept, residual sum of squares and HC1 variance, one row per group.

    HC1 of the slope is n/(n-2) * sum((x-mean)^2 e^2) / Sxx^2, so one more pass with the group's
    means attached is all that is needed.
    """
    stats = line_stats(f, by)
    if by:
        stats = materialise(stats)
    dx = F.col("_x") - F.col("_mx")
    e = (F.col("_y") - F.col("_my")) - ratio(F.col("_sxy"), F.col("_sxx")) * dx
    second = group_agg(attach(f, stats, by), by, *_carry("_n", "_my", "_mx", "_sxx", "_sxy", "_syy"),
                       F.sum(dx * dx * e * e).alias("_meat"), F.sum(e * e).alias("_rss"), *extra)
    b = ratio(F.col("_sxy"), F.col("_sxx"))
    n = F.col("_n")
    return (second.withColumn("_b", b)
            .withColumn("_a", F.col("_my") - b * F.col("_mx"))
            .withColumn("_se", F.sqrt(ratio(n, n - 2) * F.col("_meat")) / F.col("_sxx"))
            .withColumn("_r2", F.coalesce(1 - ratio(F.col("_rss"), F.col("_syy")), F.lit(0.0))))


def _line_error(least: int, text: str = "too few rows") -> Column:
    n = F.coalesce(F.col("_n"), F.lit(0))
    return (F.when(n < least, F.concat(F.lit(f"{text} ("), n.cast("string"), F.lit(")")))
            .when(~(F.col("_sxx") > 0), F.lit("the predictor does not vary")))


def _line_rows(fit: DataFrame, by, model, outcome, treatment, error, ci="t", **more) -> DataFrame:
    values = dict(estimate=F.col("_b"), intercept=F.col("_a"), se=F.col("_se"), df=F.col("_n") - 2,
                  r_squared=F.col("_r2"), n_obs=F.col("_n"), x_mean=F.col("_mx"),
                  se_type=F.lit("HC1 robust"))
    values.update(more)
    return regression_rows(fit, by, model, outcome, treatment, error, values, ci)


def ols(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = (),
        model: str = "ols") -> DataFrame:
    """y = a + b x with HC1 standard errors; the interval uses 1.96."""
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by)
    return _line_rows(line_fit(f, by), by, model, outcome, treatment, _line_error(5), "normal")


def pooled_ols(df, outcome, treatment, by=()):
    """OLS over all rows of a panel."""
    return ols(df, outcome, treatment, by, "pooled_ols")


def log_linear(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """ln y = a + b x on rows with y > 0; extra holds the semi-elasticity in percent."""
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by).where(F.col("_y") > 0)
    fit = line_fit(f.withColumn("_y", F.ln("_y")), by)
    semi = (F.exp("_b") - 1) * 100
    return _line_rows(fit, by, "log_linear", outcome, treatment,
                      _line_error(5, "too few rows above zero"),
                      extra=F.create_map(F.lit("semi_elasticity_percent"), semi))


def log_log(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """ln y = a + b ln x on rows with x, y > 0; the estimate is the elasticity.

    ``x_mean`` stays on the scale of the regression (the mean of ln x).
    """
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by).where(
        (F.col("_y") > 0) & (F.col("_x") > 0))
    fit = line_fit(f.select(*by, F.ln("_y").alias("_y"), F.ln("_x").alias("_x")), by)
    return _line_rows(fit, by, "log_log", outcome, treatment,
                      _line_error(5, "too few rows above zero"),
                      extra=F.create_map(F.lit("elasticity"), F.col("_b")))


# ---------------------------------------------------------------------------------------------
# Quadratic
# ---------------------------------------------------------------------------------------------

def quadratic_fit(f: DataFrame, by: Sequence[str]) -> DataFrame:
    """y on 1, d, d^2 with d = x - mean(x). In these terms the slope at the mean is the d term.

    Three passes: means; centred sums up to the fourth power; residuals for the 2x2 HC1 meat of
    (d, q), where q is d^2 made orthogonal to the intercept.
    """
    means = group_agg(f, by, F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mx"),
                      F.avg("_y").alias("_my"), F.var_pop("_x").alias("_vx"))
    if by:
        means = materialise(means)
    d = F.col("_x") - F.col("_mx")
    q = d * d - F.col("_vx")
    y = F.col("_y") - F.col("_my")
    carried = ("_n", "_mx", "_my", "_vx")
    sums = group_agg(attach(f, means, by), by, *_carry(*carried), F.sum(d * d).alias("_sdd"),
                     F.sum(d * q).alias("_sdq"), F.sum(q * q).alias("_sqq"),
                     F.sum(d * y).alias("_sdy"), F.sum(q * y).alias("_sqy"),
                     F.sum(y * y).alias("_syy"))
    det = F.col("_sdd") * F.col("_sqq") - F.col("_sdq") * F.col("_sdq")
    solid = F.col("_sdd") * F.col("_sqq") * 1e-12 < det
    sums = (sums.withColumn("_det", F.when(solid, det))
            .withColumn("_b1", (F.col("_sqq") * F.col("_sdy") - F.col("_sdq") * F.col("_sqy")) / F.col("_det"))
            .withColumn("_b2", (F.col("_sdd") * F.col("_sqy") - F.col("_sdq") * F.col("_sdy")) / F.col("_det")))
    if by:
        sums = materialise(sums)
    # Influence of a row on b1: (Sqq d - Sdq q) / det, so its HC1 variance is one sum.
    pull = (F.col("_sqq") * d - F.col("_sdq") * q) / F.col("_det")
    e = y - F.col("_b1") * d - F.col("_b2") * q
    carried += ("_sdd", "_sqq", "_sdq", "_sdy", "_syy", "_det", "_b1", "_b2")
    return group_agg(attach(f, sums, by), by, *_carry(*carried),
                     F.sum(pull * pull * e * e).alias("_meat"), F.sum(e * e).alias("_rss"))


def polynomial_ols(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """y = a + b x + c x^2; the estimate is the marginal effect at the mean of x, HC1 errors."""
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by)
    fit = quadratic_fit(f, by)
    n = F.col("_n")
    count = F.coalesce(n, F.lit(0))
    error = (F.when(count < 8, F.concat(F.lit("too few rows ("), count.cast("string"), F.lit(")")))
             .when(F.col("_det").isNull(), F.lit("Predictor does not identify a quadratic")))
    linear = F.col("_b1") - 2 * F.col("_b2") * F.col("_mx")
    start = (F.col("_my") - F.col("_b2") * F.col("_vx") - F.col("_b1") * F.col("_mx")
             + F.col("_b2") * F.col("_mx") * F.col("_mx"))
    return regression_rows(fit, by, "polynomial_ols", outcome, treatment, error, dict(
        estimate=F.col("_b1"), intercept=start, se=F.sqrt(ratio(n, n - 3) * F.col("_meat")),
        df=n - 3, r_squared=F.coalesce(1 - ratio(F.col("_rss"), F.col("_syy")), F.lit(0.0)),
        n_obs=n, x_mean=F.col("_mx"), se_type=F.lit("HC1 robust"),
        extra=F.create_map(F.lit("linear_term"), linear, F.lit("quadratic_term"), F.col("_b2"))))


# ---------------------------------------------------------------------------------------------
# One-way fixed effects and first differences
# ---------------------------------------------------------------------------------------------

def entity_fe(df: DataFrame, outcome: str, treatment: str, unit: str,
              by: Sequence[str] = ()) -> DataFrame:
    """Within-unit slope with unit-clustered errors, from per-unit sums only (one fact pass)."""
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by, [unit])
    units = materialise(line_stats(f, [*by, unit]))
    total = group_agg(units, by, F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_g"),
                      F.sum("_sxx").alias("_sxx"), F.sum("_sxy").alias("_sxy"), F.sum("_syy").alias("_syy"),
                      (F.sum(F.col("_n") * F.col("_mx")) / F.sum("_n")).alias("_mx"),
                      (F.sum(F.col("_n") * F.col("_my")) / F.sum("_n")).alias("_my"))
    slope = total.select(*by, "_sxx", "_sxy").select(*by, ratio(F.col("_sxy"), F.col("_sxx")).alias("_b"))
    score = F.col("_sxy") - F.col("_b") * F.col("_sxx")
    meat = group_agg(attach(units, slope, by), by, F.sum(score * score).alias("_meat"),
                     F.any_value("_b").alias("_b"))
    fit = attach(total, meat, by)
    n, g = F.col("_n"), F.col("_g")
    error = (F.when((F.coalesce(n, F.lit(0)) < 8) | (g < 2), "eight rows in two units are the least")
             .when(~(F.sqrt(F.col("_sxx") / n) >= TINY_SD), "the predictor does not vary inside units"))
    return regression_rows(fit, by, "entity_fe", outcome, treatment, error, dict(
        estimate=F.col("_b"), intercept=F.col("_my") - F.col("_b") * F.col("_mx"),
        se=cluster_scale("_meat", "_sxx", g), df=g - 1,
        r_squared=F.coalesce(F.col("_b") * ratio(F.col("_sxy"), F.col("_syy")), F.lit(0.0)),
        n_obs=n, n_units=g, x_mean=F.col("_mx"), se_type=F.lit("clustered (unit level)"),
        fe_type=F.lit("Entity fixed effects")))


def cluster_scale(meat: str, sxx: str, groups: Column) -> Column:
    """Clustered standard error of one absorbed slope: G/(G-1) correction, k = 1."""
    return F.sqrt(ratio(groups, groups - 1) * F.col(meat)) / F.col(sxx)


def time_fe(df: DataFrame, outcome: str, treatment: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope after removing period means; HC1 with k = 1 (absorbed effects are not counted)."""
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by, [time])
    periods = materialise(line_stats(f, [*by, time]))
    total = group_agg(periods, by, F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_g"),
                      F.sum("_sxx").alias("_sxx"), F.sum("_sxy").alias("_sxy"), F.sum("_syy").alias("_syy"),
                      (F.sum(F.col("_n") * F.col("_mx")) / F.sum("_n")).alias("_gx"),
                      (F.sum(F.col("_n") * F.col("_my")) / F.sum("_n")).alias("_gy"))
    total = total.withColumn("_b", ratio(F.col("_sxy"), F.col("_sxx")))
    if by:
        total = materialise(total)
    means = periods.select(*by, time, "_mx", "_my")
    dx = F.col("_x") - F.col("_mx")
    rows = attach(f.join(means, [*by, time]), total.select(*by, "_b"), by)
    e = (F.col("_y") - F.col("_my")) - F.col("_b") * dx
    meat = group_agg(rows, by, F.sum(dx * dx * e * e).alias("_meat"), F.sum(e * e).alias("_rss"))
    fit = attach(total, meat, by)
    n = F.col("_n")
    error = (F.when((F.coalesce(n, F.lit(0)) < 8) | (F.col("_g") < 2),
                    "eight rows in two periods are the least")
             .when(~(F.sqrt(F.col("_sxx") / n) >= TINY_SD), "No variation after absorbing time effects"))
    return regression_rows(fit, by, "time_fe", outcome, treatment, error, dict(
        estimate=F.col("_b"), intercept=F.col("_gy") - F.col("_b") * F.col("_gx"),
        se=F.sqrt(ratio(n, n - 1) * F.col("_meat")) / F.col("_sxx"), df=n - 1,
        r_squared=F.coalesce(1 - ratio(F.col("_rss"), F.col("_syy")), F.lit(0.0)), n_obs=n,
        n_periods=F.col("_g"), x_mean=F.col("_gx"), se_type=F.lit("HC1 robust"),
        fe_type=F.lit("Time fixed effects")))


def difference_rows(df: DataFrame, outcome: str, treatment: str, time: str, unit: str,
                    by: Sequence[str] = (), max_series_rows: int | None = None) -> DataFrame:
    """One row per unit and period (mean of repeats) with the change since the unit's last period."""
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_x": treatment, "_time": time}, by, [unit])
    cells = materialise(f.groupBy(*by, unit, "_time").agg(F.avg("_y").alias("_y"), F.avg("_x").alias("_x")))
    s = Series.of(cells, [*by, unit], "_time", max_series_rows).lag(
        _y1=("_y", 1), _x1=("_x", 1), _x2=("_x", 2))
    return (s.rows().where(F.col("_x1").isNotNull())
            .select(*by, unit, "_time", (F.col("_y") - F.col("_y1")).alias("_y"),
                    (F.col("_x") - F.col("_x1")).alias("_x"), F.col("_x2").isNull().alias("_first")))


def first_difference(df: DataFrame, outcome: str, treatment: str, time: str, unit: str,
                     by: Sequence[str] = (), max_series_rows: int | None = None) -> DataFrame:
    """Change in y on change in x within units, HC1."""
    by = list(by)
    d = difference_rows(df, outcome, treatment, time, unit, by, max_series_rows)
    fit = line_fit(d.select(*by, "_y", "_x", "_first"), by, F.count_if("_first").alias("_units"))
    return _line_rows(fit, by, "first_difference", outcome, treatment,
                      _line_error(5, "too few changes"),
                      n_units=F.col("_units"), fe_type=F.lit("First differences"))


# ---------------------------------------------------------------------------------------------
# Standard errors on their own
# ---------------------------------------------------------------------------------------------

def hc1_se(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Heteroscedasticity-robust covariance of (intercept, slope)."""
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by)
    stats = line_stats(f, by)
    if by:
        stats = materialise(stats)
    rows = attach(f, stats, by)
    dx = F.col("_x") - F.col("_mx")
    e = (F.col("_y") - F.col("_my")) - ratio(F.col("_sxy"), F.col("_sxx")) * dx
    # Influence of a row on the two coefficients: slope dx/Sxx, intercept 1/n - mean(x) dx/Sxx.
    on_slope = ratio(dx, F.col("_sxx"))
    on_start = 1 / F.col("_n") - F.col("_mx") * on_slope
    return _sandwich(group_agg(rows, by, F.any_value("_n").alias("_n"),
                               F.sum(on_start * on_start * e * e).alias("_v00"),
                               F.sum(on_start * on_slope * e * e).alias("_v01"),
                               F.sum(on_slope * on_slope * e * e).alias("_v11")),
                     by, ratio(F.col("_n"), F.greatest(F.col("_n") - 2, F.lit(1))))


def cluster_se(df: DataFrame, outcome: str, treatment: str, cluster: str,
               by: Sequence[str] = ()) -> DataFrame:
    """Covariance of (intercept, slope) of y = a + b x, clustered on ``cluster``."""
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by, [cluster])
    stats = line_stats(f, by)
    if by:
        stats = materialise(stats)
    rows = attach(f, stats, by)
    dx = F.col("_x") - F.col("_mx")
    e = (F.col("_y") - F.col("_my")) - ratio(F.col("_sxy"), F.col("_sxx")) * dx
    on_slope = ratio(dx, F.col("_sxx"))
    on_start = 1 / F.col("_n") - F.col("_mx") * on_slope
    scores = rows.groupBy(*by, cluster).agg(
        F.any_value("_n").alias("_n"), F.sum(on_start * e).alias("_s0"), F.sum(on_slope * e).alias("_s1"))
    sums = group_agg(scores, by, F.any_value("_n").alias("_n"), F.count(F.lit(1)).alias("_g"),
                     F.sum(F.col("_s0") * F.col("_s0")).alias("_v00"),
                     F.sum(F.col("_s0") * F.col("_s1")).alias("_v01"),
                     F.sum(F.col("_s1") * F.col("_s1")).alias("_v11"))
    g, n = F.col("_g"), F.col("_n")
    scale = F.when((g > 1) & (n > 2), (g / (g - 1)) * ((n - 1) / (n - 2))).otherwise(F.lit(1.0))
    return _sandwich(sums, by, scale, F.col("_g").alias("n_clusters"))


def _sandwich(sums: DataFrame, by, scale: Column, *more: Column) -> DataFrame:
    return sums.select(
        *by, F.col("_n").alias("n_obs"), *more, (scale * F.col("_v00")).alias("var_intercept"),
        (scale * F.col("_v01")).alias("cov_intercept_slope"), (scale * F.col("_v11")).alias("var_slope"),
        F.sqrt(positive_part(scale * F.col("_v00"))).alias("se_intercept"),
        F.sqrt(positive_part(scale * F.col("_v11"))).alias("se_slope"))

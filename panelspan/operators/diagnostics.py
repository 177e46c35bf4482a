"""Assumption checks. Each check gives one ``diagnostic_result`` row per group."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_numeric, ratio
from ..functions.dist import chi2_sf_udf, doubles, norm_cdf_udf, norm_ppf, norm_ppf_udf, norm_sf, t_tail_udf
from ..plans.scale import Series, attach, group_agg, materialise
from ..spec import DIAGNOSTIC_SCHEMA, shape_rows
from .forecast import ar1_fit, series_prepare
from .panel import demean_cells, panel_cells, panel_facts
from .regress import line_stats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ADF_CHUNK = 20_000      # periods of one stretch in the unit root test
NOTHING = "none"

# MacKinnon (1994) response surface for the p-value of the constant-only unit root test.
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_SPLIT, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
# MacKinnon (2010) 5 % critical value as a polynomial in 1/n.
TAU_CRIT_5 = (-2.86154, -2.8903, -4.234, -40.040)
# Level-stationarity critical values at 10, 5, 2.5 and 1 percent.
KPSS_CRIT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def check_rows(df: DataFrame, by: Sequence[str], suite: str, check_id: str, test: str,
               statistic: Column, pvalue: Column | None, violated: Column, why_not: Column,
               bad: Column, good: Column, correction: str, series: str | None = None,
               detail: Column | None = None) -> DataFrame:
    ran = why_not.isNull()
    values = dict(
        suite=F.lit(suite), check_id=F.lit(check_id), test=F.lit(test), series_name=F.lit(series),
        statistic=F.when(ran, statistic), pvalue=F.when(ran, pvalue) if pvalue is not None else F.lit(None),
        status=F.when(~ran, "not_run").when(violated, "violated").otherwise("ok"),
        interpretation=F.when(~ran, why_not).when(violated, bad).otherwise(good),
        correction=F.when(ran & violated, correction).otherwise(NOTHING))
    if detail is not None:
        values["detail"] = F.when(ran, detail)
    return shape_rows(df, DIAGNOSTIC_SCHEMA, by, values)


def _text(template: str, *cols) -> Column:
    return F.format_string(template, *cols)


# --- residual frames ------------------------------------------------------------------------------

def ols_residuals(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = (),
                  keep: Sequence[str] = ()) -> DataFrame:
    """Rows with ``_e`` (residual) and ``_fit`` of y = a + b x."""
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_x": treatment}, by, [k for k in keep if k not in by])
    stats = line_stats(f, by).select(*by, "_my", "_mx", F.coalesce(ratio(F.col("_sxy"), F.col("_sxx")),
                                                                   F.lit(0.0)).alias("_b"))
    if by:
        stats = materialise(stats)
    fit = F.col("_my") + F.col("_b") * (F.col("_x") - F.col("_mx"))
    return attach(f, stats, by).select(*by, *[k for k in keep if k not in by], (F.col("_y") - fit).alias("_e"),
                                       fit.alias("_fit"))


def panel_residuals(df: DataFrame, outcome: str, treatment: str, time: str, unit: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """Residuals of the two-way fixed effects fit, one row per fact: ``_unit, _time, _e, _fit``.

    When no cell repeats, the cells are the facts and nothing is joined back.
    """
    by = list(by)
    cells = materialise(panel_cells(df, outcome, treatment, time, unit, by))
    facts = materialise(panel_facts(cells, by))
    rows, _ = demean_cells(cells, facts, by)
    n = F.col("_n")
    slope = group_agg(rows, by, F.coalesce(ratio(F.sum(F.col("_sxy") + n * F.col("_dx") * F.col("_dy")),
                                                 F.sum(F.col("_sxx") + n * F.col("_dx") * F.col("_dx"))),
                                           F.lit(0.0)).alias("_b"))
    base = attach(rows, slope, by).withColumn("_e0", F.col("_dy") - F.col("_b") * F.col("_dx"))
    base = base.select(*by, "_unit", "_time", "_mx", "_my", "_b", "_e0")
    if not facts.where(F.col("_max") > 1).limit(1).count():
        return base.select(*by, "_unit", "_time", F.col("_e0").alias("_e"), (F.col("_my") - F.col("_e0")).alias("_fit"))
    f = clean_numeric(df, {"_y": outcome, "_x": treatment, "_time": time}, by, [unit]).withColumnRenamed(unit, "_unit")
    e = F.col("_e0") + (F.col("_y") - F.col("_my")) - F.col("_b") * (F.col("_x") - F.col("_mx"))
    return f.join(base, [*by, "_unit", "_time"]).select(*by, "_unit", "_time", e.alias("_e"), (F.col("_y") - e).alias("_fit"))


# --- checks on residuals ----------------------------------------------------------------------------

def breusch_pagan(resid: DataFrame, by: Sequence[str] = (), suite: str = "") -> DataFrame:
    """LM = n R2 of squared residuals on fitted values, chi-square(1).

    ``detail.lm_compat`` holds the scale-dependent ratio (SS of e^2 / SS of fit) n / 2.
    """
    u = F.col("_e") * F.col("_e")
    s = group_agg(resid, by, F.count(F.lit(1)).alias("_n"), F.regr_r2(u, F.col("_fit")).alias("_r2"),
                  F.regr_sxx(u, F.col("_fit")).alias("_sf"), F.regr_syy(u, F.col("_fit")).alias("_su"))
    s = s.withColumn("_lm", F.col("_n") * F.col("_r2"))
    s = s.withColumn("_p", chi2_sf_udf(F.coalesce("_lm", F.lit(0.0)), F.lit(1.0)))
    return check_rows(s, by, suite, "breusch_pagan", "Breusch-Pagan", F.col("_lm"), F.col("_p"), F.col("_p") < 0.05,
                      F.when(~(F.coalesce("_sf", F.lit(0.0)) >= 1e-15),
                             "the fitted values do not vary"),
                      _text("squared residuals move with the fit (p=%.4f)", F.col("_p")),
                      _text("squared residuals do not move with the fit (p=%.4f)", F.col("_p")), "read the HC1 errors",
                      detail=F.create_map(F.lit("lm_compat"), ratio(F.col("_su"), F.col("_sf")) * F.col("_n") / 2))


def durbin_watson(resid: DataFrame, order: Sequence[str] | str, unit: Sequence[str] = (), by: Sequence[str] = (),
                  suite: str = "", max_series_rows: int | None = None) -> DataFrame:
    """Sum of squared changes over sum of squares; changes never cross units."""
    s = Series.of(resid, [*by, *unit], order, max_series_rows).lag(_e1=("_e", 1)).rows()
    d = F.col("_e") - F.col("_e1")
    a = group_agg(s, by, F.count(F.lit(1)).alias("_n"), ratio(F.sum(d * d), F.sum(F.col("_e") * F.col("_e"))).alias("_dw"))
    dw = F.col("_dw")
    return check_rows(a, by, suite, "durbin_watson", "Durbin-Watson", dw, None, F.abs(dw - 2) > 0.5,
                      F.when((F.col("_n") < 3) | dw.isNull(), "fewer than three residuals, or all zero"),
                      _text("DW %.3f is more than 0.5 away from 2: neighbours in time are related", dw), _text("DW %.3f is within 0.5 of 2", dw),
                      "model the time order, or use errors that allow for it")


def ljung_box(series: DataFrame, order: str, by: Sequence[str] = (), lags: int = 10, suite: str = "",
              value: str = "_e", max_series_rows: int | None = None) -> DataFrame:
    """Portmanteau Q over ``lags`` autocorrelations of each series."""
    by = list(by)
    mean = group_agg(series, by, F.avg(value).alias("_m"))
    c = attach(series, materialise(mean) if by else mean, by).select(*by, order, (F.col(value) - F.col("_m")).alias("_c"))
    s = Series.of(c, by, order, max_series_rows).lag(**{f"_c{k}": ("_c", k) for k in range(1, lags + 1)}).rows()
    a = group_agg(s, by, F.count(F.lit(1)).alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_g0"),
                  *[F.coalesce(F.sum(F.col("_c") * F.col(f"_c{k}")), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)])
    n = F.col("_n")
    q = n * (n + 2) * sum((ratio(F.col(f"_g{k}"), F.col("_g0")) * ratio(F.col(f"_g{k}"), F.col("_g0"))
                           * ratio(F.lit(1.0), n - k) for k in range(1, lags + 1)), F.lit(0.0))
    a = a.withColumn("_q", q).withColumn("_p", chi2_sf_udf(F.coalesce("_q", F.lit(0.0)), F.lit(float(lags))))
    p = F.col("_p")
    return check_rows(a, by, suite, "ljung_box", f"Ljung-Box (lag={lags})", F.col("_q"), p, p < 0.05,
                      F.when((n < lags + 2) | F.col("_q").isNull(), f"{lags} lags need at least {lags + 2} points that vary"),
                      _text("the first lags are jointly related (p=%.4f)", p),
                      _text("the first lags show no joint relation (p=%.4f)", p),
                      "add AR or MA terms")


def _royston(n: int, ss: float, total: float, dot: float, wide: float, inner: float) -> tuple[float | None, float | None]:
    """W and p by Royston's published approximation, from sums over ranks.

    ``total`` and ``dot`` are the sums of m m and m x over all ranks, m being the normal scores; ``wide`` and ``inner`` are the
    distances of the two outermost values and of the two after them, whose weights differ from their scores.
    """
    if n < 3 or not ss > 0:
        return None, None
    last, before = norm_ppf((np.array([n, n - 1]) - 0.375) / (n + 0.25))
    u = 1.0 / np.sqrt(n)
    # Published polynomial coefficients, highest power first.
    outer = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u) + last / np.sqrt(total)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) + before / np.sqrt(total)
    if n == 3:
        sums = np.sqrt(0.5) * wide
    elif n <= 5:
        sums = outer * wide + (dot - last * wide) / np.sqrt((total - 2 * last ** 2) / (1 - 2 * outer ** 2))
    else:
        scale = np.sqrt((total - 2 * last ** 2 - 2 * before ** 2) / (1 - 2 * outer ** 2 - 2 * second ** 2))
        sums = outer * wide + second * inner + (dot - last * wide - before * inner) / scale
    w = min(float(sums) ** 2 / ss, 1.0)
    if n == 3:
        return w, float(max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75)))))
    low = np.log(max(1.0 - w, 1e-300))
    if n <= 11:
        bound = -2.273 + 0.459 * n
        if low >= bound:
            return w, 1e-99
        y = -np.log(bound - low)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, size = low, np.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], size)
        sd = np.exp(np.polyval([0.0030302, -0.082676, -0.4803], size))
    return w, float(norm_sf((y - mu) / sd))


@F.pandas_udf(doubles("w", "p"))
def _royston_udf(n: pd.Series, ss: pd.Series, total: pd.Series, dot: pd.Series, wide: pd.Series, inner: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_royston(int(r[0]), *r[1:]) for r in zip(n, ss, total, dot, wide, inner)], columns=["w", "p"]).astype(float)


def shapiro_wilk(resid: DataFrame, by: Sequence[str] = (), suite: str = "", max_series_rows: int | None = None) -> DataFrame:
    """W of all residuals of a group: the squared correlation of its sorted values with normal scores, ends reweighted.

    Ranks come from the ordered positions of ``Series``, which cuts a large group into ranges, and everything else from one
    aggregate, so that no task holds a group. Rows without a residual do not count. The p-value's published approximation
    was made for up to 5,000 values; beyond, W is as exact, and p is the approximation carried on (tiny departures from a
    normal law become significant, as in any test of so many values).
    """
    by = list(by)
    keys = by or ["_all"]
    rows = resid.where(F.col("_e").isNotNull()).select(*by, "_e")
    facts = materialise(group_agg(rows, by, F.count(F.lit(1)).alias("_n"), F.avg("_e").alias("_m")))
    named = rows if by else rows.withColumn("_all", F.lit(0))
    placed = Series.of(named, keys, "_e", max_series_rows).number("_i").rows()
    n, i = F.col("_n"), F.col("_i")
    scored = attach(placed, facts, by).select(*keys, "_i", "_n", (F.col("_e") - F.col("_m")).alias("_x"),
                                              norm_ppf_udf((i.cast("double") - 0.375) / (n.cast("double") + 0.25)).alias("_z"))

    def at(rank: Column) -> Column:
        return F.max(F.when(i == rank, F.col("_x")))

    x, z = F.col("_x"), F.col("_z")
    sums = scored.groupBy(*keys).agg(F.sum(x * x).alias("_ss"), F.sum(z * z).alias("_total"), F.sum(z * x).alias("_dot"),
                                     (at(n) - at(F.lit(1))).alias("_wide"), (at(n - 1) - at(F.lit(2))).alias("_inner"))
    full = facts.join(sums, by, "left") if by else attach(facts, group_agg(sums, by, *[F.max(c).alias(c) for c in ("_ss", "_total", "_dot", "_wide", "_inner")]), by)
    zero = F.lit(0.0)
    full = full.withColumn("_w", _royston_udf(F.coalesce(n, F.lit(0)), *[F.coalesce(c, zero) for c in ("_ss", "_total", "_dot", "_wide", "_inner")]))
    w, p = F.when(~F.isnan("_w.w"), F.col("_w.w")), F.when(~F.isnan("_w.p"), F.col("_w.p"))
    return check_rows(full, by, suite, "shapiro_wilk", "Shapiro-Wilk", w, p, p < 0.05,
                      F.when(p.isNull(), "fewer than three residuals, or all alike"), _text("W speaks against a normal law (p=%.4f)", p),
                      _text("W fits a normal law (p=%.4f)", p), "use robust or bootstrap errors",
                      detail=F.create_map(F.lit("n_used"), n.cast("double")))


def jarque_bera(resid: DataFrame, by: Sequence[str] = (), suite: str = "") -> DataFrame:
    """Normality of all residuals from their skewness and kurtosis: n / 6 (S^2 + (K - 3)^2 / 4), chi-square(2). One aggregate."""
    s = group_agg(resid, by, F.count("_e").alias("_n"), F.skewness("_e").alias("_s"), F.kurtosis("_e").alias("_k"))
    stat = F.col("_n") / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)
    s = s.withColumn("_jb", F.when(~F.isnan(stat), stat))
    p = F.exp(-F.col("_jb") / 2)
    return check_rows(s, by, suite, "jarque_bera", "Jarque-Bera", F.col("_jb"), p, p < 0.05,
                      F.when((F.col("_n") < 3) | F.col("_jb").isNull(), "fewer than three residuals, or all alike"),
                      _text("skewness %.3f and excess kurtosis %.3f are not those of a normal law (p=%.4f)", F.col("_s"), F.col("_k"), p),
                      _text("skewness %.3f and excess kurtosis %.3f fit a normal law (p=%.4f)", F.col("_s"), F.col("_k"), p), "use robust or bootstrap errors",
                      detail=F.create_map(F.lit("skewness"), F.col("_s"), F.lit("excess_kurtosis"), F.col("_k"), F.lit("n_used"), F.col("_n").cast("double")))


def vif(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Variance inflation of each column given the others (with intercept), plus the form without
    intercept and with centred total sum of squares (``vif_compat``). One aggregate per table."""
    by, k = list(by), len(columns)
    f = clean_numeric(df, {f"_c{i}": c for i, c in enumerate(columns)}, by)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    c = [F.col(f"_c{i}") for i in range(k)]
    s = group_agg(f, by, F.count(F.lit(1)).alias("n_obs"),
                  F.array(*[F.covar_pop(c[i], c[j]) for i, j in pairs]).alias("_cov"),
                  F.array(*[F.avg(c[i] * c[j]) for i, j in pairs]).alias("_raw"))

    def inflate(cov: pd.Series, raw: pd.Series) -> pd.DataFrame:
        at = np.triu_indices(k)
        out = []
        for cv, rw in zip(cov, raw):
            full, plain = np.zeros((k, k)), np.zeros((k, k))
            full[at], plain[at] = cv, rw
            full, plain = full + np.triu(full, 1).T, plain + np.triu(plain, 1).T
            sd = np.sqrt(np.maximum(np.diag(full), 0))
            good = np.flatnonzero(np.isfinite(sd) & (sd > 0))       # a constant column or an empty table has no inflation
            centred, compat = [None] * k, [None] * k
            if len(good):
                found = np.diag(np.linalg.pinv((full / np.outer(np.maximum(sd, 1e-300), np.maximum(sd, 1e-300)))[np.ix_(good, good)]))
                for i, v in zip(good, found):
                    centred[i] = float(v)
            for i in good:
                rest = [j for j in good if j != i]
                fit = np.linalg.lstsq(plain[np.ix_(rest, rest)], plain[rest, i], rcond=None)[0]
                r2 = 1 - (plain[i, i] - fit @ plain[rest, i]) / full[i, i]
                compat[i] = float(1 / (1 - r2)) if r2 < 1 else np.inf
            out.append((centred, compat))
        return pd.DataFrame(out, columns=["vif", "compat"])

    done = s.withColumn("_v", F.pandas_udf(inflate, "vif array<double>, compat array<double>")("_cov", "_raw"))
    names = F.array(*[F.lit(n) for n in columns])
    zipped = F.arrays_zip(names.alias("column"), F.col("_v.vif").alias("vif"), F.col("_v.compat").alias("compat"))
    return (done.select(*by, "n_obs", F.explode(zipped).alias("_z"))
            .select(*by, F.col("_z.column").alias("column"), "n_obs", F.col("_z.vif").alias("vif"),
                    F.col("_z.compat").alias("vif_compat"), (F.col("_z.vif") > 10).alias("violated")))


# --- unit root and stationarity -----------------------------------------------------------------------

def _lag_sums(y: np.ndarray, at: int, own: int, least: int, lags: int) -> np.ndarray:
    """Of a stretch whose first value is number ``at`` (from 1), over own times t >= ``own`` and t >= ``least``: sums of
    change(t) change(t - j), then of level(t - 1) change(t - j), for j = 0..lags, and of level(t - 1) and its square."""
    out = np.zeros(2 * lags + 4)
    first = max(own, least) - at            # index of the first t
    if first >= len(y):
        return out
    change = np.concatenate([[0.0], np.diff(y)])
    now, level = change[first:], y[first - 1:-1]
    for j in range(lags + 1):
        before = change[first - j:len(y) - j]
        out[j], out[lags + 1 + j] = now @ before, level @ before
    out[-2], out[-1] = level.sum(), level @ level
    return out


def _products(sums: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, lags: int, use: int) -> np.ndarray:
    """Products of (1, level, lagged changes 1..use, change) over t = use + 2..n from sums over t = lags + 2..n.

    ``head`` and ``tail`` are the first and the last lags + 1 values: a product of two lagged changes is the product of the
    same distance one step later, but for one time at either end.
    """
    early = _lag_sums(head, 1, use + 2, use + 2, use) if use < lags else np.zeros(2 * use + 4)
    distance = sums[:use + 1] + early[:use + 1]
    cross = sums[lags + 1:lags + 2 + use] + early[use + 1:2 * use + 2]
    g = np.empty((use + 3, use + 3))
    order = [use + 2, *range(2, use + 2)]               # where change(t - j) stands, the change itself last
    grid = np.zeros((use + 1, use + 1))
    grid[0] = distance
    left, right = np.diff(head[:use + 1])[::-1], np.diff(tail)[::-1]    # change(use + 1 - j) and change(n - j), j = 0..use - 1
    for i in range(use):
        grid[i + 1, i + 1:] = grid[i, i:use] + left[i] * left[i:use] - right[i] * right[i:use]
    grid = np.triu(grid) + np.triu(grid, 1).T
    g[np.ix_(order, order)] = grid
    rows = n - use - 1
    ones = tail[::-1][:use + 1] - head[use::-1][:use + 1]               # sums of change(t - j)
    g[0, 0], g[1, 1] = rows, sums[-1] + early[-1]
    g[0, 1] = g[1, 0] = sums[-2] + early[-2]
    g[0, order] = g[order, 0] = ones
    g[1, order] = g[order, 1] = cross
    return g


def _nested(g: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the regressions on the first 2, 3, ... columns: one factorisation holds them all."""
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    x, y = (g / np.outer(size, size))[:-1, :-1], (g / np.outer(size, size))[:-1, -1]
    try:
        low = np.linalg.cholesky(x)
        if np.diag(low).min() < 1e-6:
            raise np.linalg.LinAlgError
        part = np.linalg.solve(low, y)
        left = 1.0 - np.cumsum(part ** 2)[1:]
    except np.linalg.LinAlgError:           # columns that depend on each other
        left = np.array([1.0 - y[:k] @ np.linalg.lstsq(x[:k, :k], y[:k], rcond=None)[0] for k in range(2, len(x) + 1)])
    return np.maximum(left * g[-1, -1], 1e-300)


def _unit_root(sums: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, lags: int) -> tuple:
    """Lag of the smallest AIC on the sample that all lags share, and the t value of the level with it on its own sample."""
    rows, lag = n - lags - 1, 0
    if rows <= 2:
        return None, None, None
    if lags:
        k = np.arange(2, lags + 3)
        ssr = _nested(_products(sums, head, tail, n, lags, lags))
        aic = np.where(rows > k, rows * (np.log(2 * np.pi * ssr / rows) + 1) + 2 * k, np.inf)
        lag = int(aic.argmin())
    g, rows = _products(sums, head, tail, n, lags, lag), n - lag - 1
    k = lag + 2
    if rows <= k:
        return None, None, None
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    g = g / np.outer(size, size)
    inverse = np.linalg.pinv(g[:-1, :-1], hermitian=True)
    beta = inverse @ g[:-1, -1]
    var = max(g[-1, -1] - beta @ g[:-1, -1], 1e-300) / (rows - k) * inverse[1, 1]
    return float(lag), float(beta[1] / np.sqrt(var)) if var > 0 else 0.0, float(rows)


def unit_root_pvalue(tau: Column) -> Column:
    def poly(c):
        out = F.lit(0.0)
        for a in reversed(c):
            out = out * tau + a
        return out
    z = F.when(tau <= TAU_SPLIT, poly(TAU_SMALL)).otherwise(poly(TAU_LARGE))
    p = norm_cdf_udf(F.coalesce(z, F.lit(0.0)))
    return F.when(tau < TAU_MIN, 0.0).when(tau > TAU_MAX, 1.0).otherwise(p)


def adf_test(series: DataFrame, by: Sequence[str] = (), auto_lag: bool = True, suite: str = "", name: str = "series", value: str = "_y",
             order: str = "_t", max_series_rows: int | None = None, chunk: int = ADF_CHUNK) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag by AIC on a common sample.

    ``series`` has one row per period. The regressions of all candidate lags need only sums of products at each distance,
    which are added up over stretches of at most ``chunk`` periods (each with the few values before it), and the values at
    both ends. Candidates grow with the fourth root of the length and all take part; nothing of a series is ever in one
    place but these sums.
    """
    by = list(by)
    keys = by or ["_all"]
    rows = (series if by else series.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull())
    facts = materialise(group_agg(rows if by else series, by, F.count(value).alias("_n"), F.avg(value).alias("_m")))
    n = F.col("_n")
    cap = F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2)
    lags = (F.greatest(cap, F.lit(0)) if auto_lag else F.lit(0)).cast("int")
    centred = attach(rows, facts, by).select(*keys, order, "_n", lags.alias("_lags"), (F.col(value) - F.col("_m")).alias("_v"))
    placed = Series.of(centred, keys, order, max_series_rows).number("_i").rows()
    size = F.greatest(F.lit(chunk), F.col("_lags") + 1)
    own = F.floor((F.col("_i") - 1) / size)
    also = F.col("_i") > (own + 1) * size - F.col("_lags") - 1         # the next stretch looks back on it
    dealt = placed.select(*keys, "_i", "_v", "_n", "_lags", size.alias("_size"), F.explode(
        F.when(also & ((own + 1) * size < n), F.array(own, own + 1)).otherwise(F.array(own))).alias("_chunk"))
    arrays = dealt.groupBy(*keys, "_chunk", "_n", "_lags", "_size").agg(
        F.min("_i").alias("_at"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda r: r["_v"]).alias("_ys"))

    def summed(ys: pd.Series, at: pd.Series, begins: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([_lag_sums(np.asarray(y, dtype=float), int(a), max(int(b), 2), int(m) + 2, int(m)) for y, a, b, m in zip(ys, at, begins, k)])

    summed.__annotations__ = {"ys": pd.Series, "at": pd.Series, "begins": pd.Series, "k": pd.Series, "return": pd.Series}
    sums = arrays.select(*keys, F.posexplode(F.pandas_udf(summed, "array<double>")("_ys", "_at", F.col("_chunk") * F.col("_size") + 1, "_lags")).alias("_k", "_s"))
    sums = sums.groupBy(*keys, "_k").agg(F.sum("_s").alias("_s"))
    sums = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_s"))), lambda r: r["_s"]).alias("_sums"))

    def end_values(inside: Column, name: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("_i", "_v")))), lambda r: r["_v"]).alias(name)

    ends = placed.where((F.col("_i") <= F.col("_lags") + 1) | (F.col("_i") >= n - F.col("_lags"))).groupBy(*keys).agg(
        end_values(F.col("_i") <= F.col("_lags") + 1, "_head"), end_values(F.col("_i") >= n - F.col("_lags"), "_tail"),
        F.any_value("_n").alias("_n"), F.any_value("_lags").alias("_lags"))

    def solve(sums: pd.Series, head: pd.Series, tail: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
        found = [_unit_root(*(np.asarray(v, dtype=float) for v in (s, h, t)), int(m), int(lags)) for s, h, t, m, lags in zip(sums, head, tail, n, k)]
        return pd.DataFrame(found, columns=["lag", "t", "n"]).astype(float)

    solve.__annotations__ = {c: pd.Series for c in ("sums", "head", "tail", "n", "k")} | {"return": pd.DataFrame}
    solver = F.pandas_udf(solve, "lag double, t double, n double")
    fit = sums.join(ends, keys).select(*by, solver("_sums", "_head", "_tail", "_n", "_lags").alias("_r")).select(*by, "_r.*")
    out = facts.join(fit, by, "left") if by else attach(facts, group_agg(fit, by, *[F.max(c).alias(c) for c in ("lag", "t", "n")]), by)
    out = out.withColumn("_p", unit_root_pvalue(F.col("t")))
    p, size = F.col("_p"), F.col("n")
    crit = F.lit(TAU_CRIT_5[0]) + TAU_CRIT_5[1] / size + TAU_CRIT_5[2] / (size * size) + TAU_CRIT_5[3] / (size * size * size)
    return check_rows(out, by, suite, "adf", "ADF (Augmented Dickey-Fuller)", F.col("t"), p, p >= 0.05,
                      F.when((n < 4) | F.col("t").isNull(), "a unit root test takes four points at least"),
                      _text("a unit root is not ruled out (p=%.4f)", p),
                      _text("a unit root is ruled out (p=%.4f)", p), "work with first differences", name,
                      F.create_map(F.lit("lag"), F.col("lag"), F.lit("n_used"), size, F.lit("crit_5"), crit))


def kpss_test(series: DataFrame, by: Sequence[str] = (), lag: int | None = None, suite: str = "",
              name: str = "series", value: str = "_y", order: str = "_t", max_series_rows: int | None = None) -> DataFrame:
    """Level stationarity. The Bartlett long-run variance of bandwidth L is the mean square of rolling
    sums of L+1 residuals, so it needs the running sum and one self join on the position, whatever L is."""
    by = list(by)
    facts = materialise(group_agg(series, by, F.count(value).alias("_n"), F.avg(value).alias("_m")))
    e = attach(series.where(F.col(value).isNotNull()), facts, by).select(
        *by, order, "_n", (F.col(value) - F.col("_m")).alias("_e"))
    s = Series.of(e, by, order, max_series_rows).number("_i")
    s = s.running_sum(_s=F.col("_e"), _w=F.col("_e") * F.col("_i"))
    rows = materialise(s.rows().select(*by, "_i", "_n", "_e", "_s", "_w"))
    n = F.col("_n")

    def shifted(by_how_much: Column, *cols: str) -> DataFrame:
        """Rows with the running sums of an earlier position (0 before the start)."""
        past = rows.select(*by, F.col("_i").alias("_j"), *[F.col(c).alias(f"{c}_p") for c in cols])
        left = rows.withColumn("_j", F.col("_i") - by_how_much)
        return left.join(past, [*by, "_j"], "left").fillna(0.0, [f"{c}_p" for c in cols])

    if lag is None:     # automatic bandwidth of Hobijn, Franses and Ooms
        near = F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int")
        r = shifted(near + 1, "_s", "_w")
        before_s, before_w = F.col("_s") - F.col("_e"), F.col("_w") - F.col("_e") * F.col("_i")
        window = before_s - F.col("_s_p")
        ramp = F.col("_i") * window - (before_w - F.col("_w_p"))
        width = group_agg(r, by, F.any_value("_n").alias("_n"), F.sum(F.col("_e") * F.col("_e")).alias("_e2"),
                          F.sum(F.col("_e") * window).alias("_a"), F.sum(F.col("_e") * ramp).alias("_r"))
        s0 = (F.col("_e2") + 2 * F.col("_a")) / n
        s1 = 2 * F.col("_r") / n
        gamma = 1.1447 * F.pow(F.pow(ratio(s1, s0), F.lit(2.0)), F.lit(1.0 / 3.0))
        width = width.select(*by, F.least(F.floor(F.coalesce(gamma, F.lit(0.0)) * F.pow(n, F.lit(1.0 / 3.0))), n - 1)
                             .cast("int").alias("_lag"))
        width = materialise(width)
        rows = attach(rows, width, by)
    else:
        rows = rows.withColumn("_lag", F.least(F.lit(lag), n - 1).cast("int"))
    r = shifted(F.col("_lag") + 1, "_s")
    roll = F.col("_s") - F.col("_s_p")
    tail = F.when((F.col("_i") >= n - F.col("_lag")) & (F.col("_i") < n), F.col("_s") * F.col("_s")).otherwise(0.0)
    a = group_agg(r, by, F.any_value("_lag").alias("_lag"), F.sum(F.col("_s") * F.col("_s")).alias("_eta"),
                  F.sum(roll * roll + tail).alias("_lrv"))
    out = facts.join(a, by, "left") if by else attach(facts, a, by)
    variance = F.col("_lrv") / (n * (F.col("_lag") + 1))
    out = out.withColumn("_stat", ratio(F.col("_eta") / (n * n), variance))
    stat = F.col("_stat")
    p = F.when(stat < KPSS_CRIT[0], KPSS_P[0])
    for (c0, p0), (c1, p1) in zip(zip(KPSS_CRIT, KPSS_P), zip(KPSS_CRIT[1:], KPSS_P[1:])):
        p = p.when(stat <= c1, p0 + (stat - c0) / (c1 - c0) * (p1 - p0))
    p = p.otherwise(KPSS_P[-1])
    out = out.withColumn("_p", p)
    p = F.col("_p")
    return check_rows(out, by, suite, "kpss", "KPSS", stat, p, p < 0.05,
                      F.when((n < 5) | stat.isNull(), "a level test takes five points that vary"),
                      _text("the level wanders (p=%.4f)", p), _text("the level holds (p=%.4f)", p),
                      "work with differences", name, F.create_map(F.lit("lag"), F.col("_lag").cast("double")))


# --- difference in differences --------------------------------------------------------------------------

def parallel_trends(df: DataFrame, outcome: str, treatment: str, time: str, unit: str,
                    by: Sequence[str] = (), suite: str = "") -> DataFrame:
    """Difference of the pre-treatment time slopes of ever-treated and other units.

    In y = 1 + t + treated + treated*t the interaction is the difference of two separate slopes and
    its variance is the pooled error variance times (1/Stt_1 + 1/Stt_0): sums over cells suffice.
    """
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_x": treatment, "_time": time}, by, [unit])
    cells = materialise(f.groupBy(*by, F.col(unit).alias("_unit"), "_time").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_my"), F.regr_syy("_y", "_y").alias("_syy"), F.max("_x").alias("_tx")))
    units = cells.groupBy(*by, "_unit").agg((F.max("_tx") > 0).alias("_treated"))
    start = group_agg(cells, by, F.min(F.when(F.col("_tx") > 0, F.col("_time"))).alias("_start"))
    if by:
        start = materialise(start)
    pre = attach(cells.join(units, [*by, "_unit"]), start, by).where(F.col("_time") < F.col("_start"))
    arms = materialise(pre.groupBy(*by, "_treated").agg(
        F.sum("_n").alias("_m"), (F.sum(F.col("_n") * F.col("_time")) / F.sum("_n")).alias("_mt"),
        (F.sum(F.col("_n") * F.col("_my")) / F.sum("_n")).alias("_ma")))
    dt, dy, w = F.col("_time") - F.col("_mt"), F.col("_my") - F.col("_ma"), F.col("_n")
    lines = pre.join(arms, [*by, "_treated"]).groupBy(*by, "_treated").agg(
        F.any_value("_m").alias("_m"), F.sum(w * dt * dt).alias("_stt"), F.sum(w * dt * dy).alias("_sty"),
        F.sum(F.col("_syy") + w * dy * dy).alias("_syy"), F.min("_time").alias("_t0"), F.max("_time").alias("_t1"))
    slope = ratio(F.col("_sty"), F.col("_stt"))
    lines = lines.withColumn("_b", slope).withColumn("_rss", F.col("_syy") - F.coalesce(F.col("_b") * F.col("_sty"), F.lit(0.0)))
    pick = lambda c, t: F.max(F.when(F.col("_treated") == t, F.col(c)))      # noqa: E731
    s = group_agg(lines, by, F.sum("_m").alias("_n"), F.sum("_rss").alias("_rss"), pick("_b", True).alias("_b1"),
                  pick("_b", False).alias("_b0"), pick("_stt", True).alias("_s1"), pick("_stt", False).alias("_s0"),
                  (F.min("_t0") < F.max("_t1")).alias("_two"))
    out = start.join(s, by, "left") if by else attach(start, s, by)
    n = F.coalesce(F.col("_n"), F.lit(0))
    diff = F.col("_b1") - F.col("_b0")
    se = F.sqrt(F.greatest(F.col("_rss"), F.lit(0.0)) / (n - 4) * (ratio(F.lit(1.0), F.col("_s1")) + ratio(F.lit(1.0), F.col("_s0"))))
    out = out.withColumn("_d", diff).withColumn("_se", F.when(n > 4, se))
    out = out.withColumn("_t", F.when(F.col("_se") > 0, F.col("_d") / F.col("_se")).otherwise(0.0))
    out = out.withColumn("_p", t_tail_udf(F.coalesce("_t", F.lit(0.0)), F.greatest(n - 4, F.lit(1)).cast("double"))["pvalue"])
    p = F.col("_p")
    why = (F.when(F.col("_start").isNull(), F.lit("no unit is ever treated"))
           .when((n < 10) | ~F.coalesce("_two", F.lit(False)),
                 _text("%d rows before treatment; ten over two periods are needed", n))
           .when(F.col("_d").isNull() | F.col("_se").isNull(), F.lit("the slopes before treatment cannot be told apart")))
    return check_rows(out, by, suite, "parallel_trends", "Parallel Trends (pre-trend regression)", F.col("_d"), p, p < 0.10, why,
                      _text("before treatment the slopes of both groups differ (p=%.3f)", p),
                      _text("before treatment the slopes of both groups agree (p=%.3f)", p),
                      "do not read the effect as causal; match units first",
                      detail=F.create_map(F.lit("interaction_se"), F.col("_se"), F.lit("first_treatment_period"), F.col("_start"),
                                          F.lit("n_pre"), n.cast("double")))


# --- suites ------------------------------------------------------------------------------------------------

def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arima_diagnostics(df: DataFrame, outcome: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """ADF, ADF of the first difference (where the level fails), KPSS, and Ljung-Box and Jarque-Bera on
    AR(1) residuals, on series with one row per period."""
    by, suite = list(by), "arima"
    s = series_prepare(df, outcome, time, by)
    level = materialise(adf_test(s, by, suite=suite, name=outcome))
    lagged = Series.of(s, by, "_t").lag(_y1=("_y", 1)).rows().where(F.col("_y1").isNotNull())
    change = adf_test(lagged.select(*by, "_t", (F.col("_y") - F.col("_y1")).alias("_y")), by, suite=suite,
                      name=f"{outcome} (1st diff)").withColumn("check_id", F.lit("adf_diff"))
    bad = level.where(F.col("status") == "violated").select(*by, F.lit(True).alias("_bad"))
    if by:
        change = change.join(bad, by, "left_semi")
    elif not bad.limit(1).count():
        change = change.limit(0)
    ar = ar1_fit(lagged, by).select(*by, F.col("_my").alias("_mean"), F.col("_mx").alias("_mean1"),
                                    F.coalesce("_b", F.lit(0.0)).alias("_b"))
    if by:
        ar = materialise(ar)
    fit = F.col("_mean") + F.col("_b") * (F.col("_y1") - F.col("_mean1"))
    resid = attach(lagged, ar, by).select(*by, "_t", (F.col("_y") - fit).alias("_e"), fit.alias("_fit"))
    return _union([level, change, kpss_test(s, by, suite=suite, name=outcome), ljung_box(resid, "_t", by, suite=suite),
                   jarque_bera(resid, by, suite)])


def did_diagnostics(df: DataFrame, outcome: str, treatment: str, time: str, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Parallel trends, and Breusch-Pagan, Durbin-Watson and Jarque-Bera on two-way residuals."""
    by, suite = list(by), "did"
    resid = materialise(panel_residuals(df, outcome, treatment, time, unit, by))
    cells = resid.groupBy(*by, "_unit", "_time").agg(F.avg("_e").alias("_e"))
    return _union([parallel_trends(df, outcome, treatment, time, unit, by, suite), breusch_pagan(resid, by, suite),
                   durbin_watson(cells, "_time", ["_unit"], by, suite), jarque_bera(resid, by, suite)])


def ols_diagnostics(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Breusch-Pagan and Jarque-Bera on least-squares residuals."""
    resid = ols_residuals(df, outcome, treatment, by)
    return _union([breusch_pagan(resid, by, "ols"), jarque_bera(resid, by, "ols")])


FORECAST_MODELS = ("arima", "linear_trend", "exp_smoothing", "random_walk")
PANEL_MODELS = ("diff_in_diff", "panel_ols", "first_difference", "entity_fe")


def pick_diagnostics(model: str) -> Callable:
    """The suite that belongs to a model."""
    return (arima_diagnostics if model in FORECAST_MODELS else did_diagnostics if model in PANEL_MODELS
            else ols_diagnostics)


# Fixed values: (model, failed check) -> model to use instead.
SWITCH = (("diff_in_diff", "parallel_trends", "first_difference"), ("panel_ols", "durbin_watson", "first_difference"),
          ("panel_ols", "ljung_box", "first_difference"))


def corrective_switch(checks: DataFrame, chosen: DataFrame, admissible: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Model to use after the checks: the corrective one when its check failed and it is admissible.

    ``chosen``: by..., model; ``admissible``: rows of ``admissible_models``. Joins are on the group.
    """
    by = list(by)
    failed = group_agg(checks, by, F.collect_set(F.when(F.col("status") == "violated", F.col("check_id"))).alias("_bad"))
    valid = group_agg(admissible, by, F.collect_set(F.when(F.col("status") == "valid", F.col("model"))).alias("_ok"))
    out = chosen.select(*by, "model")
    for extra in (failed, valid):
        out = out.join(extra, by, "left") if by else attach(out, extra, by)
    new, why = None, None
    for model, check, target in SWITCH:
        hit = ((F.col("model") == model) & F.array_contains("_bad", check) & F.array_contains("_ok", target))
        new = F.when(hit, target) if new is None else new.when(hit, target)
        why = F.when(hit, check) if why is None else why.when(hit, check)
    return out.select(*by, "model", F.coalesce(new, F.col("model")).alias("final_model"), why.alias("because"))

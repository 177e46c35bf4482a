"""Forecasts of every series in a table.

A series is first reduced to one row per period. All models then work on that table with ordered
operations from ``Series`` (which split long series) and per-series aggregates.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..plans.scale import Series, attach, exact_quantile, group_agg, materialise
from ..spec import FORECAST_SCHEMA, shape_rows
from .prepare import series_by_time
from .regress import Z95, line_fit

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 20))    # 0.05 .. 0.95
CHUNK = 20_000              # points of one series folded in one array
ORDER_PARTS = 6
FIT_ROWS = 5_000            # longest series that one task fits whole, and periods of one stretch of a longer one
FIT_BEFORE = 2_500          # periods before a stretch from which its errors start: the start weighs 0.98 ** 2500 < 1e-21 then
FIT_PASSES = 80
MAX_P = MAX_Q = 3
MAX_D = 1
ARIMA_LEAST = 10
SERIES_PER_TASK = 100


def series_prepare(df: DataFrame, outcome: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Cleaned mean per period, written once: ``by..., _t, _y``."""
    s = series_by_time(df, outcome, time, by)
    return materialise(s.select(*by, F.col("time").alias("_t"), F.col("y").alias("_y")))


def _last(by: Sequence[str], s: DataFrame) -> DataFrame:
    return group_agg(s, by, F.count(F.lit(1)).alias("_n"), F.max("_t").alias("_tlast"),
                     F.max_by("_y", "_t").alias("_ylast"), F.min("_t").alias("_tfirst"))


def _step(gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median gap between periods (1 if there is none)."""
    return exact_quantile(gaps.where(F.col("_gap").isNotNull()), "_gap", 0.5, by, "_step")


def _frame(df, outcome, time, by, max_series_rows=None):
    """Prepared series with the previous value and gap, and the facts per series."""
    by = list(by)
    s = series_prepare(df, outcome, time, by)
    lagged = Series.of(s, by, "_t", max_series_rows).lag(_y1=("_y", 1), _t1=("_t", 1)).rows()
    lagged = lagged.withColumn("_gap", F.col("_t") - F.col("_t1"))
    facts, step = _last(by, s), _step(lagged, by)
    if by:
        facts = facts.join(step, by, "left")
    else:
        facts = attach(facts, step.agg(F.max("_step").alias("_step")), by)
    step = F.col("_step")
    facts = facts.withColumn("_step", F.when(step > 0, step).otherwise(F.lit(1.0)))
    return lagged, facts


def forecast_rows(fit: DataFrame, by: Sequence[str], model: str, periods: int, error: Column,
                  point: Column, band: Column, **more: Column) -> DataFrame:
    """One row per horizon step; a failed series gives one error row."""
    steps = fit.withColumn("_error", error).withColumn(
        "h", F.explode(F.when(F.col("_error").isNull(), F.sequence(F.lit(1), F.lit(periods)))
                       .otherwise(F.array(F.lit(None).cast("int")))))
    ok = F.col("_error").isNull()
    values = dict(model=F.lit(model), status=F.when(ok, "ok").otherwise("error"), error=F.col("_error"),
                  h=F.col("h"), time=F.when(ok, F.col("_tlast") + F.col("h") * F.col("_step")),
                  forecast=F.when(ok, point), ci_lower=F.when(ok, point - band), ci_upper=F.when(ok, point + band),
                  last_value=F.col("_ylast"), n_obs=F.coalesce(F.col("_n"), F.lit(0)))
    values.update({k: F.when(ok, v) for k, v in more.items()})
    return shape_rows(steps, FORECAST_SCHEMA, by, values)


def _need(least: int) -> Column:
    return F.when(F.coalesce(F.col("_n"), F.lit(0)) < least, F.lit(f"{least} points are the least"))


def forecast_random_walk(df: DataFrame, outcome: str, time: str, periods: int = 10,
                         by: Sequence[str] = (), max_series_rows: int | None = None) -> DataFrame:
    """The last value carried forward; spread from the root mean square change."""
    by = list(by)
    lagged, facts = _frame(df, outcome, time, by, max_series_rows)
    d = F.col("_y") - F.col("_y1")
    rmse = group_agg(lagged, by, F.sqrt(F.avg(d * d)).alias("_rmse"))
    fit = attach(facts, rmse, by)
    return forecast_rows(fit, by, "random_walk", periods, _need(3), F.col("_ylast"),
                         Z95 * F.col("_rmse") * F.sqrt("h"), rmse=F.col("_rmse"), engine=F.lit("naive"))


def ar1_fit(lagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """y_t on y_{t-1}: one row per series with _a, _b, _rss and the number of pairs _n."""
    pairs = lagged.where(F.col("_y1").isNotNull()).select(*by, "_y", F.col("_y1").alias("_x"))
    return line_fit(pairs, by)


def forecast_ar1(df: DataFrame, outcome: str, time: str, periods: int = 10, by: Sequence[str] = (),
                 max_series_rows: int | None = None) -> DataFrame:
    """y_t = c + phi y_{t-1} by least squares, iterated forward in closed form."""
    by = list(by)
    lagged, facts = _frame(df, outcome, time, by, max_series_rows)
    ar = ar1_fit(lagged, by).select(*by, F.col("_a"), F.coalesce("_b", F.lit(0.0)).alias("_b"), "_my", "_rss",
                                    F.col("_n").alias("_pairs"))
    fit = attach(facts, ar, by) if not by else facts.join(ar, by, "left")
    phi = F.col("_b")
    start = F.coalesce("_a", "_my")       # a constant series has no slope: its mean
    power = F.pow(phi, F.col("h"))
    total = F.when(phi == 1.0, F.col("h").cast("double")).otherwise((1 - power) / (1 - phi))
    rmse = F.sqrt(F.col("_rss") / F.col("_pairs"))
    aic = 4 + F.col("_pairs") * F.ln(F.col("_rss") / F.col("_pairs"))
    return forecast_rows(fit, by, "ar1", periods, _need(3), start * total + power * F.col("_ylast"),
                         Z95 * rmse * F.sqrt("h"), rmse=rmse, aic=F.when(F.col("_rss") > 0, aic),
                         p=F.lit(1), d=F.lit(0), q=F.lit(0), ar1=phi, engine=F.lit("ar1"))


def forecast_linear_trend(df: DataFrame, outcome: str, time: str, periods: int = 10,
                          by: Sequence[str] = (), max_series_rows: int | None = None) -> DataFrame:
    """Least-squares line in time; band 1.96 rmse sqrt(1 + h/n)."""
    by = list(by)
    lagged, facts = _frame(df, outcome, time, by, max_series_rows)
    line = line_fit(lagged.select(*by, "_y", F.col("_t").alias("_x")), by).select(*by, "_b", "_my", "_mx", "_rss")
    fit = attach(facts, line, by)
    at = F.col("_tlast") + F.col("h") * F.col("_step")
    rmse = F.sqrt(F.col("_rss") / F.col("_n"))
    return forecast_rows(fit, by, "linear_trend", periods, _need(3),
                         F.col("_my") + F.col("_b") * (at - F.col("_mx")),
                         Z95 * rmse * F.sqrt(1 + F.col("h") / F.col("_n")), rmse=rmse, engine=F.lit("ols_trend"))


# ---------------------------------------------------------------------------------------------
# Exponential smoothing
# ---------------------------------------------------------------------------------------------

def smoothing_scores(series: DataFrame, by: Sequence[str], alphas: Sequence[float] = ALPHAS,
                     max_series_rows: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Squared one-step error and final level per series and alpha.

    The level after a stretch of data is linear in the level before it, and the squared error is
    quadratic in it. So stretches of at most ``chunk`` points are folded on their own, and only
    their five numbers are folded again along the series.
    """
    by = list(by)
    s = Series.of(series, by, "_t", max_series_rows).number("_i").rows()
    first = group_agg(s, by, F.min_by("_y", "_i").alias("_y0"))
    rest = (s.where(F.col("_i") > 1).withColumn("_chunk", F.floor((F.col("_i") - 2) / chunk))
            .groupBy(*by, "_chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_y"))),
                                                    lambda r: r["_y"]).alias("_ys")))
    grid = rest.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    zero = F.lit(0.0)
    start = F.struct(F.lit(1.0).alias("p"), zero.alias("q"), zero.alias("a"), zero.alias("b"), zero.alias("c"))
    alpha = F.col("alpha")

    def point(acc, y):
        miss = y - acc["q"]
        return F.struct(((1 - alpha) * acc["p"]).alias("p"), (acc["q"] + alpha * miss).alias("q"),
                        (acc["a"] + miss * miss).alias("a"), (acc["b"] + miss * acc["p"]).alias("b"),
                        (acc["c"] + acc["p"] * acc["p"]).alias("c"))

    parts = grid.select(*by, "alpha", "_chunk", F.aggregate("_ys", start, point).alias("_s"))
    chain = parts.groupBy(*by, "alpha").agg(F.sort_array(F.collect_list(F.struct("_chunk", "_s"))).alias("_parts"))
    chain = attach(chain, first, by)

    def stretch(acc, part):
        s, level = part["_s"], acc["level"]
        return F.struct((s["p"] * level + s["q"]).alias("level"),
                        (acc["sse"] + s["a"] - 2 * s["b"] * level + s["c"] * level * level).alias("sse"))

    end = F.aggregate("_parts", F.struct(F.col("_y0").alias("level"), zero.alias("sse")), stretch)
    return chain.select(*by, "alpha", end.alias("_e")).select(*by, "alpha", "_e.level", "_e.sse")


def forecast_exp_smoothing(df: DataFrame, outcome: str, time: str, periods: int = 10,
                           by: Sequence[str] = (), alphas: Sequence[float] = ALPHAS,
                           max_series_rows: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Simple exponential smoothing; alpha from a grid by least squared one-step error."""
    by = list(by)
    lagged, facts = _frame(df, outcome, time, by, max_series_rows)
    scores = smoothing_scores(lagged.select(*by, "_t", "_y"), by, alphas, max_series_rows, chunk)
    best = group_agg(scores, by, F.min(F.struct("sse", "alpha", "level")).alias("_best"))
    fit = facts.join(best, by, "left") if by else attach(facts, best, by)
    rmse = F.sqrt(F.greatest(F.col("_best.sse"), F.lit(0.0)) / (F.col("_n") - 1))
    return forecast_rows(fit, by, "exp_smoothing", periods, _need(4), F.col("_best.level"),
                         Z95 * rmse * F.sqrt("h"), rmse=rmse, alpha=F.col("_best.alpha"), engine=F.lit("grid"))


# ---------------------------------------------------------------------------------------------
# ARIMA
# ---------------------------------------------------------------------------------------------

ORDER = MAX_P + MAX_Q + 1          # parameters: constant, AR lags, MA lags
BATCH_POINTS = 1_000_000           # points of one vectorised batch of fits


def _arma_errors(w, theta, p):
    """One-step errors of many series at once (rows), zero before position p.

    ``theta`` columns: constant, AR 1..3, MA 1..3; unused lags are zero.
    """
    return np.ascontiguousarray(_errors_by_time(np.ascontiguousarray(w.T), theta.T, p).T)


def _errors_by_time(w, theta, p):
    """The same with a row per period and a column per series, also in ``theta``."""
    e = w - theta[0]
    for i in range(1, MAX_P + 1):
        if theta[i].any():
            e[i:] -= theta[i] * w[:-i]
    e[np.arange(len(w))[:, None] < p] = 0.0
    for j in range(MAX_Q, 0, -1):
        if theta[MAX_P + j].any():
            break
    else:
        return e
    for t in range(1, len(e)):
        for i in range(1, min(j, t) + 1):
            e[t] -= theta[MAX_P + i] * e[t - i]
    return e


def _within(coef, limit):
    """Whether all roots of a lag polynomial (one per row) are well inside ``limit``: its partial autocorrelations are below 1."""
    phi, inside = coef / limit ** np.arange(1, coef.shape[1] + 1), np.ones(len(coef), dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for j in range(coef.shape[1], 0, -1):
            last = phi[:, j - 1:j]
            inside &= np.abs(last[:, 0]) < 1 - 1e-9
            phi = (phi[:, :j - 1] + last * phi[:, :j - 1][:, ::-1]) / (1 - last * last)
    return inside


def _inside(coef, limit=0.98):
    """Scale lag polynomials whose roots reach the unit circle (one per row)."""
    out, far = coef.copy(), np.flatnonzero(~_within(coef, limit))
    if not len(far):
        return out
    top = np.zeros((len(far), coef.shape[1], coef.shape[1]))
    top[:, 0, :] = coef[far]
    top[:, range(1, coef.shape[1]), range(coef.shape[1] - 1)] = 1.0
    big = np.abs(np.linalg.eigvals(top)).max(axis=1)
    shrink = np.where(big > limit, limit / np.maximum(big, 1e-12), 1.0)
    out[far] *= shrink[:, None] ** np.arange(1, coef.shape[1] + 1)
    return out


def _admissible(theta):
    out = theta.copy()
    out[:, 1:MAX_P + 1] = _inside(theta[:, 1:MAX_P + 1])
    out[:, MAX_P + 1:] = -_inside(-theta[:, MAX_P + 1:])
    return out


def _least_squares(columns, y):
    """Coefficients of many regressions of one shape; ``columns`` and ``y`` have a regression per row, periods left out are zero."""
    x = np.stack(columns, axis=2)
    size, k = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300), x.shape[2]
    out, fine = np.zeros((len(x), k)), np.zeros(len(x), dtype=bool)
    if x.shape[1] > k:
        r = np.linalg.qr(np.concatenate([x / size[:, None, :], y[:, :, None]], axis=2), mode="r")
        fine = np.abs(np.diagonal(r, axis1=1, axis2=2)[:, :k]).min(axis=1) > 1e-7
        out[fine] = np.linalg.solve(r[fine, :k, :k], r[fine, :k, k:])[:, :, 0] / size[fine]
    for i in np.flatnonzero(~fine):         # columns that depend on each other
        out[i] = np.linalg.lstsq(x[i], y[i], rcond=None)[0]
    return out


def _arma_start(w, sizes, p, q, with_const):
    """Hannan-Rissanen: a long autoregression gives errors, then one regression on lags of both. Series are rows of ``w``."""
    def back(x, i):
        out = np.zeros_like(x)
        out[:, i:] = x[:, :-i]
        return out

    theta, place = np.zeros((len(w), ORDER)), np.arange(w.shape[1])[None, :]
    shapes, group = np.unique(np.stack([np.maximum(1, np.minimum(sizes // 4, p + q + 5)), p, q, with_const], axis=1), axis=0, return_inverse=True)
    for g, (long, ar, ma, c) in enumerate(shapes.tolist()):
        who = np.flatnonzero(group.ravel() == g)
        x, ends = w[who], place < sizes[who][:, None]
        lags = [back(x, i) for i in range(1, max(long, ar) + 1)]
        on = (ends & (place >= long)).astype(float)
        rough, cols = x * on, [on, *[v * on for v in lags[:long]]]
        beta = _least_squares(cols, rough)
        for i, v in enumerate(cols):
            rough = rough - beta[:, i:i + 1] * v
        on = (ends & (place >= (long + ma if ma else ar))).astype(float)
        beta = _least_squares(([on] if c else []) + [v * on for v in lags[:ar]] + [back(rough, i) * on for i in range(1, ma + 1)], x * on)
        theta[who, :c] = beta[:, :c]
        theta[who, 1:1 + ar], theta[who, MAX_P + 1:MAX_P + 1 + ma] = beta[:, c:c + ar], beta[:, c + ar:]
    return theta


def _fit_batch(w, sizes, p, q, with_const, skip):
    """Conditional least squares of many orders and series at once: damped Gauss-Newton.

    The loss leaves out the first ``skip`` points, so that orders of a series share one sample. The errors have a row per period.
    """
    rows, size = w.shape
    place = np.arange(size)[:, None]
    used = (place >= skip) & (place < sizes)
    lags = np.arange(1, MAX_P + 1)[None, :]
    free = np.concatenate([with_const[:, None], lags <= p[:, None], lags <= q[:, None]], axis=1)
    theta, by_time = _admissible(_arma_start(w, sizes, p, q, with_const)), np.ascontiguousarray(w.T)

    def errors(th, who):
        return np.where(used[:, who], _errors_by_time(by_time[:, who], np.ascontiguousarray(th.T), p[who]), 0.0)

    e = errors(theta, np.arange(rows))
    best = (e * e).sum(axis=0)
    damp, live = np.full(rows, 1e-3), np.ones(rows, dtype=bool)
    for _ in range(30):
        who = np.flatnonzero(live)
        if not len(who):
            break
        step = 1e-6 * np.maximum(np.abs(theta[who]), 0.1)
        at, k = np.nonzero(free[who])           # one column per open fit and free parameter
        moved, change = theta[who[at]], step[at, k]
        moved[np.arange(len(at)), k] += change
        jac = np.zeros((len(who), ORDER, size))
        jac[at, k] = ((errors(moved, who[at]) - e[:, who[at]]) / change).T
        normal = jac @ jac.transpose(0, 2, 1)
        slope = (jac @ e.T[who][:, :, None])[:, :, 0]
        size_of = np.maximum(np.einsum("rkk->rk", normal), 1e-12)
        normal[:, range(ORDER), range(ORDER)] += np.where(free[who], 0.0, 1.0)
        gained, todo = np.zeros(len(who), dtype=bool), np.arange(len(who))
        for _ in range(6):
            if not len(todo):
                break
            ridge = normal[todo].copy()
            ridge[:, range(ORDER), range(ORDER)] += damp[who[todo], None] * size_of[todo]
            trial = _admissible(theta[who[todo]] - _solved(ridge, slope[todo]))
            fresh = errors(trial, who[todo])
            value = (fresh * fresh).sum(axis=0)
            good = value < best[who[todo]]
            done = who[todo[good]]
            gained[todo[good]] = (best[done] - value[good]) > 1e-8 * best[done]
            theta[done], e[:, done], best[done] = trial[good], fresh[:, good], value[good]
            damp[done] /= 5
            damp[who[todo[~good]]] *= 8
            todo = todo[~good]
        live[who[~gained]] = False
    return theta, e, best, used.sum(axis=0)


def _solved(a, b):
    """Solutions of many small symmetric systems; a singular one gets its least-squares step, one that is not finite none."""
    fine = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    a = np.where(fine[:, None, None], a, np.eye(a.shape[1]))
    b = np.where(fine[:, None], b, 0.0)[:, :, None]
    try:
        return np.linalg.solve(a, b)[:, :, 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(a, hermitian=True) @ b)[:, :, 0]


def _psi_weights(theta, d, horizon):
    """Moving-average weights of the (integrated) processes, for forecast variances: one row each."""
    poly = np.concatenate([np.ones((len(theta), 1)), -theta[:, 1:MAX_P + 1], np.zeros((len(theta), MAX_D))], axis=1)
    for k in range(MAX_D):
        once = poly.copy()
        once[:, 1:] -= poly[:, :-1]
        poly = np.where(d[:, None] > k, once, poly)
    psi = np.zeros((len(theta), horizon))
    psi[:, 0] = 1.0
    for j in range(1, horizon):
        psi[:, j] = (theta[:, MAX_P + j] if j <= MAX_Q else 0.0) - sum(
            poly[:, i] * psi[:, j - i] for i in range(1, min(j, poly.shape[1] - 1) + 1))
    return psi


def _forecast_path(last, w, e, theta, d, sigma2, horizon):
    """Forecasts and standard errors of many fits (rows) after the values ``last``, of the last values w (differenced) and errors e."""
    hist, errs, path = list(w.T), list(e.T), []
    for _ in range(horizon):
        path.append(theta[:, 0] + sum(theta[:, j] * hist[-j] for j in range(1, MAX_P + 1)) + sum(theta[:, MAX_P + j] * errs[-j] for j in range(1, MAX_Q + 1)))
        hist.append(path[-1])
        errs.append(np.zeros(len(theta)))
    path = np.stack(path, axis=1)
    path = np.where(d[:, None] > 0, last[:, None] + np.cumsum(path, axis=1), path)
    return path, np.sqrt(sigma2[:, None] * np.cumsum(_psi_weights(theta, d, horizon) ** 2, axis=1))


def _arima_batch(ys, p, d, q, horizon):
    """Fit a batch of (series, order) rows; AIC is the Gaussian conditional one on the common sample."""
    ws = [np.diff(y, k) if k else y for y, k in zip(ys, d)]
    sizes = np.array([len(x) for x in ws])
    w = np.zeros((len(ws), sizes.max()))
    for i, x in enumerate(ws):
        w[i, :len(x)] = x
    theta, e, sse, used = _fit_batch(w, sizes, p, q, d == 0, MAX_P + (MAX_D - d))
    sigma2 = np.maximum(sse / used, 1e-300)
    aic = used * (np.log(2 * np.pi * sigma2) + 1) + 2 * (p + q + (d == 0) + 1)
    every, ends = np.arange(len(ws))[:, None], sizes[:, None] + np.arange(-max(MAX_P, MAX_Q), 0)
    path, spread = _forecast_path(np.array([y[-1] for y in ys]), w[every, ends][:, -MAX_P:], e[ends, every][:, -MAX_Q:], theta, d, sigma2, horizon)
    fine, rmse = np.isfinite(aic) & np.isfinite(path).all(axis=1), np.sqrt(sigma2)
    return [(aic[i], rmse[i], theta[i, 1], path[i], spread[i]) if ok else (None,) * 5 for i, ok in enumerate(fine)]


FIT_COLUMNS = ["aic", "rmse", "ar1", "path", "spread"]
FIT_TYPE = "aic double, rmse double, ar1 double, path array<double>, spread array<double>"


def _arima_udf(horizon):
    def fit(ys: pd.Series, p: pd.Series, d: pd.Series, q: pd.Series) -> pd.DataFrame:
        ys = [np.asarray(y, dtype=float) for y in ys]
        p, d, q = (v.to_numpy(dtype=int) for v in (p, d, q))
        order = np.argsort([len(y) for y in ys], kind="stable")     # similar lengths share a batch
        rows: list = [None] * len(ys)
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * len(ys[order[stop]]) <= BATCH_POINTS:
                stop += 1
            part = order[start:stop]
            for i, r in zip(part, _arima_batch([ys[i] for i in part], p[part], d[part], q[part], horizon)):
                rows[i] = r
            start = stop
        return pd.DataFrame(rows, columns=FIT_COLUMNS)
    fit.__annotations__ = {"ys": pd.Series, "p": pd.Series, "d": pd.Series, "q": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(fit, FIT_TYPE)


def forecast_arima(df: DataFrame, outcome: str, time: str, periods: int = 10, by: Sequence[str] = (),
                   max_series_rows: int | None = None, fit_rows: int = FIT_ROWS, fit_before: int = FIT_BEFORE) -> DataFrame:
    """Order grid p, q <= 3, d <= 1 by AIC; every (series, order) pair is a row of its own.

    Series shorter than 10 points use AR(1). A series of more than ``fit_rows`` periods is fitted in stretches of that many
    (``_stretch_fits``): the same orders, sample and sums of squares, added up over tasks.
    """
    by = list(by)
    lagged, facts = _frame(df, outcome, time, by, max_series_rows)
    facts = materialise(facts)
    sizes = facts.select(*by, "_n")
    fits = []
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(facts.count() / SERIES_PER_TASK))
    fits.append(_task_fits(attach(lagged, sizes, by).where(
        F.col("_n").between(ARIMA_LEAST, fit_rows)), by, periods, tasks))
    if facts.where(F.col("_n") > fit_rows).limit(1).count():
        fits.append(_stretch_fits(attach(lagged, sizes, by).where(F.col("_n") > fit_rows).select(*by, "_n", "_t", "_y"), by, periods,
                                  max_series_rows, fit_rows, fit_before, tasks))
    grid = fits[0] if len(fits) == 1 else fits[0].unionByName(fits[1])
    # d and order are tie breakers, so that the choice does not depend on row order
    best = group_agg(grid.where(F.col("aic").isNotNull()), by, F.min(F.struct(
        "aic", "d", "p", "q", "rmse", "ar1", "path", "spread", "engine")).alias("_f"))
    long = facts.where(F.col("_n") >= ARIMA_LEAST)
    long = long.join(best, by, "left") if by else attach(long, best, by)
    path = F.try_element_at("_f.path", F.col("h"))
    band = Z95 * F.try_element_at("_f.spread", F.col("h"))
    rows = forecast_rows(long, by, "arima", periods,
                         F.when(F.col("_f").isNull(), "no order can be fitted"), path, band,
                         **{k: F.col(f"_f.{k}") for k in ("aic", "rmse", "ar1", "p", "d", "q", "engine")})
    if not facts.where(F.coalesce("_n", F.lit(0)) < ARIMA_LEAST).limit(1).count():
        return rows
    short = forecast_ar1(df, outcome, time, periods, by, max_series_rows).withColumn("model", F.lit("arima"))
    return short.where(F.col("n_obs") < ARIMA_LEAST).unionByName(rows)


def _order_grid(n: Column) -> Column:
    orders = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"))
                       for d in range(MAX_D + 1) for p in range(MAX_P + 1) for q in range(MAX_Q + 1) if p or q])
    most = F.floor(n / 5)
    return F.filter(orders, lambda o: (o["p"] <= most) & (o["q"] <= most))


def _task_fits(rows: DataFrame, by: list[str], periods: int, tasks: int) -> DataFrame:
    """One row per (series, order), fitted in vectorised batches; series are bounded here by
    ``fit_rows`` points."""
    arrays = group_agg(rows, by, F.transform(F.sort_array(F.collect_list(F.struct("_t", "_y"))),
                                             lambda r: r["_y"]).alias("_ys"))
    # The fits cost far more than their few bytes suggest, so the number of tasks is set by hand.
    # The orders of a series are dealt in ORDER_PARTS, so that one series alone is several tasks too.
    jobs = (arrays.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(ORDER_PARTS - 1)))).repartition(tasks, *by, "_part")
            .withColumn("_o", F.explode(F.filter(_order_grid(F.size("_ys")), lambda o, i: i % ORDER_PARTS == F.col("_part"))))
            .select(*by, "_ys", "_o.p", "_o.d", "_o.q"))
    fitted = jobs.withColumn("_f", _arima_udf(periods)("_ys", "p", "d", "q"))
    return fitted.select(*by, "p", "d", "q", "_f.*", F.lit("css").alias("engine"))


# --- series that are fitted in stretches ---

ORDERS = tuple((p, d, q) for d in range(MAX_D + 1) for p in range(MAX_P + 1) for q in range(MAX_Q + 1) if p or q)
UPPER = np.triu_indices(ORDER)
SUMS = 1 + ORDER + len(UPPER[0])            # per order: squared errors, their slopes, products of slopes
# Per order: parameters, parameters on trial, best squared errors, slopes and products there, damping, failures, steps, open.
PARTS = {"theta": ORDER, "trial": ORDER, "best": 1, "jte": ORDER, "jtj": len(UPPER[0]), "damp": 1, "fails": 1, "steps": 1, "live": 1}
PLACE = {k: slice(sum(list(PARTS.values())[:i]), sum(list(PARTS.values())[:i + 1])) for i, k in enumerate(PARTS)}
STATE = sum(PARTS.values())


def _free(orders):
    p, d, q = (np.array(v)[:, None] for v in zip(*orders))
    lags = np.arange(1, MAX_P + 1)[None, :]
    return np.concatenate([d == 0, lags <= p, lags <= q], axis=1)


LONGEST = MAX_P + MAX_Q + 5         # lags of the longest first autoregression


def _long_lags(p, q, n):
    return max(1, min(n // 4, p + q + 5))


def _own_rows(w, least, d, at, begins, upto):
    """Places in a stretch's w that are its own and have number ``least`` or more in the whole w of the series."""
    return np.arange(max(begins - at - d, least + 1 - at, 0), min(upto - at - d + 1, len(w)))


def _tri(columns):
    """Products of the columns, as one row."""
    c = np.column_stack(columns)
    return (c.T @ c)[np.triu_indices(c.shape[1])]


def _untri(row, k):
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = row[:k * (k + 1) // 2]
    return g + np.triu(g, 1).T


def _solve_last(g):
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-13)[0]


def _long_products(y, at, begins, upto, n, mean):
    """For both d and every length of the first autoregression: products of (1, lags, value), in a row of rows."""
    out = np.zeros((MAX_D + 1, LONGEST + 1, (LONGEST + 2) * (LONGEST + 3) // 2))
    for d in range(MAX_D + 1):
        w = np.diff(y) if d else y - mean
        for k in {_long_lags(p, q, n) for p, _, q in ORDERS}:
            rows = _own_rows(w, k, d, at, begins, upto)
            if len(rows):
                found = _tri([np.ones(len(rows)), *[w[rows - i] for i in range(1, k + 1)], w[rows]])
                out[d, k, :len(found)] = found
    return out.ravel()


def _long_coefs(row):
    """The first autoregressions from their products: constant and lags, per d and length."""
    rows = np.asarray(row, dtype=float).reshape(MAX_D + 1, LONGEST + 1, -1)
    out = np.zeros((MAX_D + 1, LONGEST + 1, LONGEST + 1))
    for d in range(MAX_D + 1):
        for k in range(1, LONGEST + 1):
            out[d, k, :k + 1] = _solve_last(_untri(rows[d, k], k + 2))
    return out.ravel()


def _start_products(y, at, begins, upto, n, mean, coefs):
    """Per order: products of (1 if d = 0, lags, lagged errors of the first autoregression, value)."""
    coefs = np.asarray(coefs, dtype=float).reshape(MAX_D + 1, LONGEST + 1, -1)
    out = np.zeros((len(ORDERS), (ORDER + 1) * (ORDER + 2) // 2))
    rough = {}
    for i, (p, d, q) in enumerate(ORDERS):
        w, k = np.diff(y) if d else y - mean, _long_lags(p, q, n)
        if (d, k) not in rough:
            e = np.zeros(len(w))
            where = np.arange(max(k, k + 1 - at), len(w))
            e[where] = w[where] - coefs[d, k, 0] - sum(coefs[d, k, j] * w[where - j] for j in range(1, k + 1))
            rough[d, k] = e
        e, rows = rough[d, k], _own_rows(w, k + q if q else p, d, at, begins, upto)
        if len(rows):
            found = _tri([*([np.ones(len(rows))] if d == 0 else []), *[w[rows - j] for j in range(1, p + 1)], *[e[rows - j] for j in range(1, q + 1)], w[rows]])
            out[i, :len(found)] = found
    return out.ravel()


def _fresh_state(row, mean):
    """The state before the first pass: every order at its start values, as in ``_arma_start``."""
    rows, start = np.asarray(row, dtype=float).reshape(len(ORDERS), -1), np.zeros((len(ORDERS), ORDER))
    for i, (p, d, q) in enumerate(ORDERS):
        c = int(d == 0)
        beta = _solve_last(_untri(rows[i], c + p + q + 1))
        start[i, 1:1 + p], start[i, MAX_P + 1:MAX_P + 1 + q] = beta[c:c + p], beta[c + p:]
        start[i, 0] = beta[0] + mean * (1 - start[i, 1:1 + p].sum()) if c else 0.0
    state = np.zeros((len(ORDERS), STATE))
    state[:, PLACE["trial"]] = state[:, PLACE["theta"]] = _admissible(start)
    state[:, PLACE["best"]], state[:, PLACE["damp"]], state[:, PLACE["live"]] = np.inf, 5e-3, 1.0
    return state.ravel()


def _stretch_sums(ys, ats, owns, upto, trials, live):
    """Of every stretch: SUMS numbers per order at its parameters on trial, over its own periods (zero where not ``live``)."""
    out = np.zeros((len(ys), len(ORDERS), SUMS))
    for d in range(MAX_D + 1):
        jobs = [(i, k) for i in range(len(ys)) for k, o in enumerate(ORDERS) if o[1] == d and live[i, k]]
        jobs.sort(key=lambda j: (ORDERS[j[1]][2] > 0, len(ys[j[0]])))       # orders without errors need no recursion
        start = 0
        while start < len(jobs):
            stop, longest = start, 0
            while stop < len(jobs) and (stop + 1 - start) * max(longest, len(ys[jobs[stop][0]])) <= BATCH_POINTS or stop == start:
                longest = max(longest, len(ys[jobs[stop][0]]))
                stop += 1
            rows, orders = [i for i, _ in jobs[start:stop]], [k for _, k in jobs[start:stop]]
            w = np.zeros((len(rows), longest - d))
            for r, i in enumerate(rows):
                w[r, :len(ys[i]) - d] = np.diff(ys[i], d) if d else ys[i]
            at = np.array([ats[i] for i in rows])[:, None] + np.arange(w.shape[1])[None, :] + d         # period of each place
            used = (at >= np.maximum([owns[i] for i in rows], MAX_P + MAX_D + 1)[:, None]) & (at <= np.array([upto[i] for i in rows])[:, None])
            theta, p, free = trials[rows, orders], np.array([ORDERS[k][0] for k in orders]), _free([ORDERS[k] for k in orders])
            e = np.where(used, _arma_errors(w, theta, p), 0.0)
            jac = np.zeros((*w.shape, ORDER))
            step = 1e-6 * np.maximum(np.abs(theta), 0.1)
            for k in range(ORDER):
                who = np.flatnonzero(free[:, k])
                if len(who):
                    moved = theta[who].copy()
                    moved[:, k] += step[who, k]
                    jac[who, :, k] = (np.where(used[who], _arma_errors(w[who], moved, p[who]), 0.0) - e[who]) / step[who, k:k + 1]
            out[rows, orders, 0] = np.einsum("rt,rt->r", e, e)
            out[rows, orders, 1:1 + ORDER] = np.einsum("rtk,rt->rk", jac, e)
            out[rows, orders, 1 + ORDER:] = np.einsum("rtk,rtl->rkl", jac, jac)[:, UPPER[0], UPPER[1]]
            start = stop
    return out.reshape(len(ys), -1)


def _next_state(state, sums):
    """A damped Gauss-Newton step of every open order: the trial is taken if it lowers the squared errors, else damped more."""
    if not len(sums):           # a series that has ended
        return state
    state, sums = np.array(state, dtype=float).reshape(len(ORDERS), STATE), np.asarray(sums, dtype=float).reshape(len(ORDERS), SUMS)
    part = {k: state[:, at] for k, at in PLACE.items()}
    live, best, free = part["live"][:, 0] > 0, part["best"][:, 0].copy(), _free(ORDERS)
    good = live & (sums[:, 0] < best)
    gained = good & (np.isinf(best) | (best - sums[:, 0] > 1e-8 * best))
    part["theta"][good], part["best"][good, 0] = part["trial"][good], sums[good, 0]
    part["jte"][good], part["jtj"][good] = sums[good, 1:1 + ORDER], sums[good, 1 + ORDER:]
    part["damp"][good] /= 5
    part["steps"][good] += 1
    part["fails"][good] = 0
    worse = live & ~good
    part["damp"][worse] *= 8
    part["fails"][worse] += 1
    part["live"][(good & ~gained) | (part["steps"][:, 0] > 30) | (part["fails"][:, 0] >= 6)] = 0.0
    who = np.flatnonzero(part["live"][:, 0] > 0)
    normal = np.zeros((len(who), ORDER, ORDER))
    normal[:, UPPER[0], UPPER[1]] = normal[:, UPPER[1], UPPER[0]] = part["jtj"][who]
    every = range(ORDER)
    normal[:, every, every] += np.where(free[who], part["damp"][who] * np.maximum(normal[:, every, every], 1e-12), 1.0)
    part["trial"][who] = _admissible(part["theta"][who] - _solved(normal, part["jte"][who])) if len(who) else part["trial"][who]
    return state.ravel()


def _stretch_ends(y, state, n, horizon):
    """The fits of all orders, with forecasts from the errors at the end of the last stretch."""
    state, out = np.asarray(state, dtype=float).reshape(len(ORDERS), STATE), []
    used = n - MAX_P - MAX_D
    for (p, d, q), row in zip(ORDERS, state):
        theta, sigma2 = row[PLACE["theta"]], max(float(row[PLACE["best"]][0]) / used, 1e-300)
        w = np.diff(y, d) if d else y
        e = _arma_errors(w[None, :].copy(), theta[None, :], np.array([p]))[0]
        aic = used * (np.log(2 * np.pi * sigma2) + 1) + 2 * (p + q + (d == 0) + 1)
        (path,), (spread,) = _forecast_path(y[-1:], w[None, -MAX_P:], e[None, -MAX_Q:], theta[None, :], np.array([d]), np.array([sigma2]), horizon)
        ok = np.isfinite(aic) and np.all(np.isfinite(path))
        out.append({"aic": aic, "rmse": np.sqrt(sigma2), "ar1": theta[1] if p else 0.0, "path": list(path), "spread": list(spread)} if ok
                   else dict.fromkeys(FIT_COLUMNS))
    return out


def _stretch_fits(series: DataFrame, by: list[str], periods: int, max_series_rows: int | None, size: int, before: int, tasks: int) -> DataFrame:
    """One row per (series, order) of series (by, _n, _t, _y) of any length, by conditional least squares as in ``_fit_batch``.

    The start values are those of ``_arma_start`` by products of lags. A series is cut into stretches. The error recursion forgets where it started, so that each stretch makes its errors from
    ``before`` earlier periods, whatever the others do. A pass adds up squared errors and slopes of all open orders over
    all stretches; the step from them is taken on one row per series.
    """
    keys = by or ["_all"]
    series = series if by else series.withColumn("_all", F.lit(0))
    placed = Series.of(series, keys, "_t", max_series_rows).number("_i").rows()
    first, last = F.floor((F.col("_i") - 1) / size), F.floor((F.col("_n") - 1) / size)
    dealt = placed.select(*keys, "_n", "_i", "_y", F.explode(F.sequence(first, F.least(last, F.floor((F.col("_i") - 1 + before + MAX_P + MAX_D) / size)))).alias("_part"))
    arrays = dealt.groupBy(*keys, "_n", "_part").agg(F.min("_i").alias("_at"), F.transform(
        F.sort_array(F.collect_list(F.struct("_i", "_y"))), lambda r: r["_y"]).alias("_ys"))
    # The fits cost far more than their few bytes suggest, so the number of tasks is set by hand.
    arrays = materialise(arrays.repartition(tasks, *keys, "_part"))
    own, upto = F.col("_part") * size + 1, F.least((F.col("_part") + 1) * size, F.col("_n"))

    def added(numbers: DataFrame) -> DataFrame:
        """Numbers of all stretches of a series, summed place by place."""
        places = numbers.select(*keys, F.posexplode("_v").alias("_k", "_s")).groupBy(*keys, "_k").agg(F.sum("_s").alias("_s"))
        return places.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_s"))), lambda r: r["_s"]).alias("_v"))

    def typed(fn, result):
        code = fn.__code__
        fn.__annotations__ = dict.fromkeys(code.co_varnames[:code.co_argcount + bool(code.co_flags & 4)], pd.Series) | {"return": pd.Series}
        return F.pandas_udf(fn, result)

    def each(fn):
        return typed(lambda *rows: pd.Series([fn(*(np.asarray(x, dtype=float) if isinstance(x, (list, np.ndarray)) else x for x in r)) for r in zip(*rows)]), "array<double>")

    mean = materialise(placed.groupBy(*keys).agg(F.avg("_y").alias("_mean")))
    known = attach(arrays, mean, keys)
    rough = materialise(added(known.select(*keys, each(_long_products)("_ys", "_at", own, upto, "_n", "_mean").alias("_v"))).select(*keys, each(_long_coefs)("_v").alias("_coefs")))
    known = attach(known, rough, keys)
    begun = added(known.select(*keys, each(_start_products)("_ys", "_at", own, upto, "_n", "_mean", "_coefs").alias("_v")))
    state = materialise(attach(begun, mean, keys).select(*keys, each(_fresh_state)("_v", "_mean").alias("_state")))

    def sums(ys, at, begins, ends, state):
        each = np.stack(list(state)).reshape(len(ys), len(ORDERS), STATE)
        found = _stretch_sums([np.asarray(y, dtype=float) for y in ys], list(at), list(begins), list(ends), each[:, :, PLACE["trial"]], each[:, :, PLACE["live"]][:, :, 0] > 0)
        return pd.Series(list(found))

    sums = typed(sums, "array<double>")
    step = each(_next_state)
    open_order = F.exists(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1)), lambda k: F.get("_state", k * STATE + PLACE["live"].start) > 0)
    for _ in range(FIT_PASSES):
        going = state.where(open_order)
        if not going.limit(1).count():
            break
        totals = added(attach(arrays, going, keys).select(*keys, sums("_ys", "_at", own, upto, "_state").alias("_v")))
        state = materialise(state.join(totals, keys, "left").select(*keys, F.when(F.col("_v").isNull(), F.col("_state")).otherwise(
            step("_state", F.coalesce("_v", F.array()))).alias("_state")))

    def ended(ys: pd.Series, n: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([_stretch_ends(np.asarray(y, dtype=float), s, int(m), periods) for y, m, s in zip(ys, n, state)])

    tail = arrays.where(F.col("_part") == last).join(state, keys)
    fits = tail.select(*by, F.posexplode(F.pandas_udf(ended, f"array<struct<{FIT_TYPE.replace(' ', ':').replace(',:', ',')}>>")("_ys", "_n", "_state")).alias("_k", "_f"))
    orders = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("pdq", o)]) for o in ORDERS])
    return materialise(fits.withColumn("_o", F.get(orders, F.col("_k"))).select(*by, "_o.p", "_o.d", "_o.q", "_f.*", F.lit("css").alias("engine")))


MODELS = {"arima": forecast_arima, "linear_trend": forecast_linear_trend,
          "exp_smoothing": forecast_exp_smoothing, "random_walk": forecast_random_walk}


def forecast_compare(df: DataFrame, outcome: str, time: str, periods: int = 10, by: Sequence[str] = (),
                     models: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """Models of each series ranked by in-sample RMSE, with the ratio to the random walk."""
    by = list(by)
    every = None
    for m in models:
        rows = MODELS[m](df, outcome, time, periods, by).where((F.col("h") == 1) & (F.col("status") == "ok"))
        rows = rows.select(*by, "model", "rmse", F.col("forecast").alias("next_forecast"), "n_obs")
        every = rows if every is None else every.unionByName(rows)
    table = group_agg(every, by, F.sort_array(F.collect_list(F.struct("rmse", "model", "next_forecast", "n_obs"))).alias("_m"),
                      F.max(F.when(F.col("model") == "random_walk", F.col("rmse"))).alias("_rw"))
    return table.select(*by, "_rw", F.posexplode("_m").alias("_p", "_r")).select(
        *by, (F.col("_p") + 1).alias("rank"), "_r.model", "_r.rmse", "_r.next_forecast", "_r.n_obs",
        ratio(F.col("_r.rmse"), F.col("_rw")).alias("vs_random_walk"))

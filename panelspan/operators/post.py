"""What comes after an estimate: scenarios, eras, robustness, outliers, insights, scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DATELIKE, as_double, clean_numeric, dtype_of, finite, is_numeric, ratio
from ..functions.dist import norm_ppf_udf
from ..plans.scale import Series, attach, exact_quantile, group_agg, materialise
from ..spec import FORECAST_SCHEMA, REGRESSION_SCHEMA, ModelSpec, add_model, drop_model
from . import median, panel, regress
from .forecast import series_prepare
from .regress import Z95

TINY = 0.001

# --- estimators by name ------------------------------------------------------------------------------

Estimator = Callable[..., DataFrame]
_LINE = {"ols": regress.ols, "pooled_ols": regress.pooled_ols, "log_linear": regress.log_linear,
         "log_log": regress.log_log, "polynomial_ols": regress.polynomial_ols, "median_quantile": median.median_quantile}
_PANEL = {"panel_ols": panel.panel_ols, "diff_in_diff": panel.diff_in_diff, "first_difference": regress.first_difference}
_CUSTOM: dict[str, Estimator] = {}


def register_estimator(name: str, fn: Estimator, spec: ModelSpec | None = None, before: str | None = None) -> None:
    """Add a model: ``fn(df, outcome, treatment, time, unit, by) -> regression rows``.

    With a ``spec`` (question type, required fields, variation within units, positive columns) it is a candidate of its
    question type too, and ``admissible_models``, ``choose_model`` and ``analyze`` treat it like the others: preferred to
    the model named ``before``, or after all.
    """
    if spec is not None:
        if spec.name != name:
            raise ValueError(f"the spec is of '{spec.name}', not of '{name}'")
        add_model(spec, before)
    _CUSTOM[name] = fn


def unregister_estimator(name: str) -> None:
    """Take an added model back."""
    _CUSTOM.pop(name, None)
    drop_model(name)


def run_model(df: DataFrame, model: str, outcome: str, treatment: str, time: str | None = None,
              unit: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    if model in _CUSTOM:
        return _CUSTOM[model](df, outcome, treatment, time, unit, by)
    if model in _LINE:
        return _LINE[model](df, outcome, treatment, by)
    if model in _PANEL:
        return _PANEL[model](df, outcome, treatment, time, unit, by)
    if model == "entity_fe":
        return regress.entity_fe(df, outcome, treatment, unit, by)
    if model == "time_fe":
        return regress.time_fe(df, outcome, treatment, time, by)
    raise ValueError(f"Unknown model '{model}'")


def _sign(c: Column) -> Column:
    return F.when(c >= 0, 1).otherwise(-1)


# --- scenarios -----------------------------------------------------------------------------------------

def _back(model: Column, value: Column) -> Column:
    """Predictions of the log models return to the scale of the outcome."""
    return F.when(model.isin("log_linear", "log_log"), F.exp(value)).otherwise(value)


def _on_scale(model: Column, x: Column) -> Column:
    return F.when(model == "log_log", F.ln(x)).otherwise(x)


def single(models: DataFrame) -> DataFrame:
    """The one row that results without keys must have; several models need keys."""
    if len(models.limit(2).collect()) > 1:
        raise ValueError("several models and no keys: name the columns that tell them apart")
    return models


def whatif_regression(models: DataFrame, scenarios: DataFrame, on: Sequence[str] = (), x: str = "x") -> DataFrame:
    """Predicted outcome at ``x`` for every scenario, with interval and change against the mean of x.

    ``models`` are ``regression_result`` rows, keyed by ``on``. Without keys there must be one model.
    """
    on = list(on)
    m = _line_parts(models, on)
    return _predicted(attach(scenarios, m if on else single(m), on), scenarios.columns, x)


def _line_parts(models: DataFrame, keep: Sequence[str]) -> DataFrame:
    bend = F.try_element_at("extra", F.lit("quadratic_term")) if "extra" in models.columns else F.lit(0.0)
    return models.where(F.col("status") == "ok").select(*keep, "model", "intercept", "estimate", "se", "x_mean", F.coalesce(bend, F.lit(0.0)).alias("_c"))


def _predicted(rows: DataFrame, keep: Sequence[str], x: str) -> DataFrame:
    at = _on_scale(F.col("model"), F.col(x))
    base, bend, start = F.coalesce("x_mean", F.lit(0.0)), F.col("_c"), F.coalesce("intercept", F.lit(0.0))
    # the slope of a quadratic is reported at the mean: move back to its linear term
    linear = F.col("estimate") - 2 * bend * base
    line = start + linear * at + bend * at * at
    calm = start + linear * base + bend * base * base
    half = Z95 * F.col("se") * F.abs(at - base)
    m_ = F.col("model")
    return rows.select(*keep, "model", _back(m_, line).alias("predicted"),
                       _back(m_, line - half).alias("pred_lower"), _back(m_, line + half).alias("pred_upper"),
                       (_back(m_, line) - _back(m_, calm)).alias("delta_vs_baseline"))


def whatif_shock(forecasts: DataFrame, shocks: DataFrame, on: Sequence[str] = (), shock: str = "shock") -> DataFrame:
    """Forecast paths after a one-period shock to the last value, fading by the AR(1) coefficient.

    Without keys there must be one series: its path, a few steps long, travels with every shock.
    """
    on = list(on)
    f = _shock_parts(forecasts, on)
    if on:
        rows = f.join(shocks, on)
    else:
        if f.groupBy("model", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or len(f.select("model").distinct().limit(2).collect()) > 1:
            raise ValueError("several series and no keys: name the columns that tell them apart")
        path = f.agg(F.collect_list(F.struct(*f.columns)).alias("_path"))
        rows = attach(shocks.select(shock), path, []).select(shock, F.explode("_path").alias("_p")).select(shock, "_p.*")
    return _shocked(rows, on, shock)


def _shock_parts(forecasts: DataFrame, keep: Sequence[str]) -> DataFrame:
    return forecasts.where(F.col("status") == "ok").select(*keep, "model", "h", "time", "forecast", "last_value", F.coalesce("ar1", F.lit(0.0)).alias("_phi"))


def _shocked(rows: DataFrame, keep: Sequence[str], shock: str) -> DataFrame:
    phi = F.col("_phi")
    fade = F.when(F.col("h") == 1, 1.0).when(F.abs(phi) < 1, F.pow(phi, F.col("h") - 1)).otherwise(0.0)
    return rows.select(*keep, "model", shock, "h", "time", (F.col("forecast") + F.col(shock) * fade).alias("forecast"),
                       (F.col("last_value") + F.col(shock)).alias("shocked_last"))


def whatif(result: DataFrame, scenario: dict) -> DataFrame:
    """One scenario for every result row: ``{"shock": v}`` or ``{"x": v}`` / ``{"treatment_value": v}``.

    All columns of ``result`` that are no result columns (the keys of its groups) stay.
    """
    if "shock" in scenario:
        keys = [c for c in result.columns if c not in dict(FORECAST_SCHEMA)]
        return _shocked(_shock_parts(result, keys).withColumn("shock", F.lit(float(scenario["shock"]))), keys, "shock")
    if "x" in scenario or "treatment_value" in scenario:
        keys = [c for c in result.columns if c not in dict(REGRESSION_SCHEMA)]
        value = float(scenario.get("x", scenario.get("treatment_value")))
        return _predicted(_line_parts(result, keys).withColumn("x", F.lit(value)), [*keys, "x"], "x")
    raise ValueError(f"a scenario names x, treatment_value or shock, not {sorted(scenario)}")


def whatif_slider(models: DataFrame, by: Sequence[str] = (), steps: int = 200) -> DataFrame:
    """Predictions on an even grid around the mean of x: half-width max(|mean|/2, 10)."""
    by = list(by)
    half = F.greatest(F.abs(F.col("x_mean")) * 0.5, F.lit(10.0))
    grid = (models.where(F.col("status") == "ok").select(*by, "x_mean", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
            .select(*by, "step", (F.col("x_mean") - half + 2 * half * F.col("step") / steps).alias("x")))
    return whatif_regression(models, grid, by)


# --- eras, groups, predictors, robustness ----------------------------------------------------------------

def era_table(t_min: float, t_max: float, events: Sequence[tuple[float, str]] = (), least_width: float = 3) -> list[dict]:
    """Half-open eras between event times (thirds of the range without events): driver-side, few rows."""
    if t_max - t_min < 10:
        return []
    inner = sorted({e for e, _ in events if t_min < e < t_max})
    if not inner:
        span = t_max - t_min
        inner = [t_min + span // 3, t_min + 2 * span // 3]
    edges = [t_min, *inner, t_max]
    eras = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if hi - lo < least_width:
            continue
        named = [name for t, name in sorted(events) if lo <= t < hi or (t == hi == t_max)]
        plain = "first span" if i == 0 else "last span" if i == len(edges) - 2 else f"span {i + 1}"
        eras.append({"era": i + 1, "lo": float(lo), "hi": float(hi), "last": i == len(edges) - 2,
                     "label": named[0][:22] if named else plain})
    return eras


def assign_era(df: DataFrame, time: str, eras: Sequence[dict]) -> DataFrame:
    """Add the era number. Eras are few fixed ranges, so this is one CASE expression and no join."""
    t = as_double(df, time)
    case = F.lit(None).cast("int")
    for e in eras:
        inside = (t >= e["lo"]) & ((t <= e["hi"]) if e["last"] else (t < e["hi"]))
        case = F.when(inside, e["era"]).otherwise(case)
    return df.withColumn("era", case).where(F.col("era").isNotNull())


def era_effects(df: DataFrame, model: str, outcome: str, treatment: str, time: str, unit: str | None = None,
                events: Sequence[tuple[float, str]] = (), least_rows: int = 10) -> DataFrame:
    """The model refitted in every era in one grouped job, with sign agreement with the full sample."""
    edge = df.select(as_double(df, time).alias("t")).where(finite("t")).agg(F.min("t"), F.max("t")).first()
    eras = era_table(float(edge[0]), float(edge[1]), events) if edge[0] is not None else []
    labels = [(e["era"], e["label"], f"{e['lo']:g}–{e['hi']:g}") for e in eras]
    spark = df.sparkSession
    names = spark.createDataFrame(labels, "era int, label string, period string")
    if not eras:
        return names.select("era", "label", "period", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("estimate", "double"), ("se", "double"), ("pvalue", "double"), ("n_obs", "long"), ("consistent", "string"))])
    fits = run_model(assign_era(df, time, eras), model, outcome, treatment, time, unit, ["era"])
    main = run_model(df, model, outcome, treatment, time, unit).select(F.col("estimate").alias("_main"))
    fits = fits.where((F.col("status") == "ok") & (F.col("n_obs") >= least_rows))
    out = attach(fits.join(F.broadcast(names), "era"), main, [])      # names: one row per era
    agree = F.when(_sign(F.col("estimate")) == _sign(F.col("_main")), "✓ consistent").otherwise("✗ sign flip")
    return out.select("era", "label", "period", "estimate", "se", "pvalue", "n_obs", agree.alias("consistent"))


def structural_break(eras: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest over smallest effect above 2.5, and whether the sign changes."""
    size = F.abs("estimate")
    a = group_agg(eras, by, F.count(F.lit(1)).alias("n_eras"), F.max(size).alias("_hi"), F.min(size).alias("_lo"),
                  (F.min(_sign(F.col("estimate"))) != F.max(_sign(F.col("estimate")))).alias("sign_reversal"))
    spread = ratio(F.col("_hi"), F.col("_lo"))
    return a.where(F.col("n_eras") >= 2).select(*by, "n_eras", spread.alias("effect_ratio"),
                                                F.coalesce(spread > 2.5, F.lit(False)).alias("structural_break"), "sign_reversal")


def robustness_table(df: DataFrame, chosen: str, models: Sequence[str], outcome: str, treatment: str,
                     time: str | None = None, unit: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Every model on the same data, with sign agreement with the chosen one."""
    by, every = list(by), None
    for m in dict.fromkeys([chosen, *models]):
        rows = run_model(df, m, outcome, treatment, time, unit, by).select(*by, "model", "status", "estimate", "se", "pvalue", "n_obs")
        every = rows if every is None else every.unionByName(rows)
    every = materialise(every)
    main = every.where(F.col("model") == chosen).select(*by, F.col("estimate").alias("_main"))
    main = main if by else main.agg(F.max("_main").alias("_main"))
    agree = (F.when(F.col("estimate").isNull() | F.col("_main").isNull(), "n/a")
             .when(_sign(F.col("estimate")) == _sign(F.col("_main")), "✓").otherwise("✗ sign flip"))
    return attach(every, main, by).select(*by, "model", "status", "estimate", "se", "pvalue", "n_obs", agree.alias("consistent"))


def split_by(df: DataFrame, model: str, outcome: str, treatment: str, group: str, time: str | None = None,
             unit: str | None = None) -> DataFrame:
    """The model in every value of a column: one grouped fit."""
    fits = run_model(df, model, outcome, treatment, time, unit, [group])
    return fits.select(F.col(group).cast("string").alias("group"), "status", F.col("n_obs").alias("n"), "estimate", "se", "pvalue")


def compare_predictors(df: DataFrame, outcome: str, predictors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """OLS of one outcome on each predictor, all in one grouped fit; a star marks the best R2."""
    by = list(by)
    num = df.select(*by, as_double(df, outcome).alias("_out"), *[as_double(df, p).alias(p) for p in predictors])
    long = num.unpivot([*by, "_out"], list(predictors), "predictor", "_value")
    fits = regress.ols(long, "_out", "_value", [*by, "predictor"])
    fits = fits.select(*by, "predictor", "status", "estimate", "se", "pvalue", "r_squared", "n_obs")
    best = group_agg(fits, by, F.max("r_squared").alias("_best"))
    star = F.when(F.col("r_squared") >= F.col("_best") - TINY, "★").otherwise("")
    return attach(fits, best, by).withColumn("stronger", star).drop("_best")


# --- score -----------------------------------------------------------------------------------------------

def confidence_score(results: DataFrame, checks: DataFrame | None = None, eras: DataFrame | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """0-100 score: significance 40, checks 25, sample 20, stability over eras 15.

    Checks that did not run do not count. ``checks`` and ``eras`` are matched on ``by``.
    """
    by = list(by)
    out = results.select(*by, "model", "pvalue", "n_obs")

    def side(frame, *aggs):
        nonlocal out
        a = group_agg(frame, by, *aggs)
        out = out.join(a, by, "left") if by else attach(out, a, by)

    if checks is not None:
        side(checks, F.count_if(F.col("status") == "ok").alias("_pass"),
             F.count_if(F.col("status") != "not_run").alias("_total"))
    else:
        out = out.withColumn("_pass", F.lit(0)).withColumn("_total", F.lit(0))
    if eras is not None:
        size = F.abs("estimate")
        side(eras, F.count("estimate").alias("_ne"), F.min(_sign(F.col("estimate"))).alias("_s0"),
             F.max(_sign(F.col("estimate"))).alias("_s1"), F.max(size).alias("_hi"), F.min(size).alias("_lo"))
    p = F.coalesce("pvalue", F.lit(1.0))
    sig = F.greatest(F.lit(0.0), 40 * (1 - 8 * F.least(F.lit(1.0), p)))
    diag = F.coalesce(25.0 * ratio(F.col("_pass"), F.col("_total")), F.lit(0.0))
    samp = 20 * F.least(F.lit(1.0), F.ln(F.greatest(F.lit(1), F.coalesce("n_obs", F.lit(0)))) / F.ln(F.lit(1000.0)))
    era = F.lit(7.5)
    if eras is not None:
        era = (F.when(F.coalesce("_ne", F.lit(0)) < 2, 7.5).when(F.col("_s0") == F.col("_s1"), 15.0)
               .when((F.col("_lo") > 0) & (F.col("_hi") / F.col("_lo") > 3), 0.0).otherwise(7.5))
    total = F.bround(sig + diag + samp + era).cast("int")
    label = F.when(total >= 70, "High confidence").when(total >= 45, "Moderate confidence").otherwise("Low confidence")
    rounded = lambda c, n: F.bround(c).cast("int").alias(n)      # noqa: E731
    return out.select(*by, "model", total.alias("score"), rounded(sig, "sig"), rounded(diag, "diag"), rounded(samp, "samp"),
                      rounded(era, "era"), label.alias("label"))


# --- curves --------------------------------------------------------------------------------------------

def _xy(df, outcome, treatment, by, keep=()):
    return clean_numeric(df, {"_y": outcome, "_x": treatment}, by, [k for k in keep if k not in by])


def _curve(df, results, outcome, treatment, by, steps, half: Callable[[], Column]) -> DataFrame:
    by = list(by)
    a = group_agg(_xy(df, outcome, treatment, by), by, F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"),
                  F.max("_x").alias("_hi"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.stddev_pop("_x").alias("_sd"))
    est = results.where(F.col("status") == "ok").select(*by, "estimate", "se")
    c = attach(a, est if by else single(est), by)
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    c = c.withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("step") / steps)
    line = F.col("_my") + F.col("estimate") * (F.col("x") - F.col("_mx"))
    return c.select(*by, "step", "x", line.alias("fit"), (line - half()).alias("lower"), (line + half()).alias("upper"))


def marginal_curve(df: DataFrame, results: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Predicted outcome over the range of x through the centroid, 41 points."""
    away = lambda: F.abs(F.col("x") - F.col("_mx")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return _curve(df, results, outcome, treatment, by, 40,
                  lambda: Z95 * F.col("se") * F.sqrt(1 / F.sqrt("_n") + away()))


def fit_line(df: DataFrame, results: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Fitted line through the centroid, 21 points."""
    return _curve(df, results, outcome, treatment, by, 20,
                  lambda: Z95 * F.col("se") * F.abs(F.col("x") - F.col("_mx")) / (F.col("_sd") + TINY))


def centroid_residuals(df: DataFrame, results: DataFrame, outcome: str, treatment: str, by: Sequence[str] = (),
                       keep: Sequence[str] = ()) -> DataFrame:
    """Rows with residual ``_e`` around the line of the estimated slope through the centroid."""
    by = list(by)
    f = _xy(df, outcome, treatment, by, keep)
    centre = group_agg(f, by, F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    est = results.where(F.col("status") == "ok").select(*by, F.col("estimate").alias("_b"))
    c = attach(centre, est if by else single(est), by)
    c = materialise(c) if by else c
    rows = attach(f, c, by)
    fit = F.col("_my") + F.col("_b") * (F.col("_x") - F.col("_mx"))
    return rows.select(*by, *[k for k in keep if k not in by], "_x", "_y", "_n", "_my", fit.alias("_fit"), (F.col("_y") - fit).alias("_e"))


def residual_frame(df: DataFrame, results: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Spread of residuals, covariance of |e| with the fit, and the heteroscedasticity flag."""
    by = list(by)
    r = centroid_residuals(df, results, outcome, treatment, by)
    ae = F.abs("_e")
    a = group_agg(r, by, F.count(F.lit(1)).alias("n_obs"), F.stddev_pop("_e").alias("resid_sd"), F.min("_fit").alias("fit_min"),
                  F.max("_fit").alias("fit_max"), F.covar_pop(F.col("_fit"), ae).alias("cov_abs_fit"), F.min(ae).alias("_lo"), F.max(ae).alias("_hi"))
    bound = 0.3 * (F.col("_hi") - F.col("_lo")) * (F.col("fit_max") - F.col("fit_min")) / F.col("n_obs")
    return a.select(*by, "n_obs", "resid_sd", "fit_min", "fit_max", "cov_abs_fit",
                    (F.abs("cov_abs_fit") > bound).alias("possible_heteroscedasticity"))


def qq_points(df: DataFrame, results: DataFrame, outcome: str, treatment: str, points: int = 100,
              by: Sequence[str] = (), accuracy: int = 100_000) -> DataFrame:
    """Standardised residual quantiles against normal quantiles at ``points`` even probabilities."""
    by = list(by)
    r = centroid_residuals(df, results, outcome, treatment, by)
    probs = [(i + 0.5) / points for i in range(points)]
    a = group_agg(r, by, F.avg("_e").alias("_m"), F.stddev_samp("_e").alias("_s"),
                  F.percentile_approx("_e", F.array(*[F.lit(p) for p in probs]), accuracy).alias("_q"))
    rows = a.select(*by, "_m", "_s", F.posexplode("_q").alias("point", "_v"))
    return rows.select(*by, "point", norm_ppf_udf((F.col("point") + 0.5) / points).alias("theoretical"),
                       ((F.col("_v") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("sample"))


# --- summaries over time ---------------------------------------------------------------------------------

def trend_summary(df: DataFrame, outcome: str, time: str, by: Sequence[str] = (), max_series_rows: int | None = None) -> DataFrame:
    """Level, spread, first against last quarter of the period means, direction and volatility."""
    by = list(by)
    f = clean_numeric(df, {"_y": outcome, "_t": time}, by)
    base = group_agg(f, by, F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"),
                     F.coalesce(F.stddev_samp("_y"), F.lit(0.0)).alias("std"), F.min("_y").alias("min"), F.max("_y").alias("max"))
    s = Series.of(series_prepare(df, outcome, time, by), by, "_t", max_series_rows).number("_i").rows()
    size = group_agg(s, by, F.count(F.lit(1)).alias("_k"))
    quarter = F.greatest(F.lit(1), F.floor(F.col("_k") / 4))
    ends = group_agg(attach(s, size, by), by,
                     F.avg(F.when(F.col("_i") <= quarter, F.col("_y"))).alias("early"),
                     F.avg(F.when(F.col("_i") > F.col("_k") - quarter, F.col("_y"))).alias("late"), F.max("_k").alias("_k"))
    out = attach(base, ends, by)
    change, seen = F.col("late") - F.col("early"), F.col("_k") >= 3
    cv = F.coalesce(ratio(F.col("std"), F.abs("mean")), F.lit(0.0))
    return out.select(*by, "n", "mean", "std", "min", "max", F.when(seen, F.col("early")).alias("early"),
                      F.when(seen, F.col("late")).alias("late"), F.when(seen, F.coalesce(ratio(change * 100, F.col("early")), F.lit(0.0))).alias("pct_change"),
                      F.when(seen, F.when(change > 0, "rose").when(change < 0, "fell").otherwise("stayed flat")).alias("direction"),
                      F.when(cv < 0.1, "low").when(cv < 0.4, "moderate").otherwise("high").alias("volatility"))


def historical_summary(df: DataFrame, outcome: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, spread, range, size and time range."""
    f = df.select(*by, as_double(df, outcome).alias("_y"), as_double(df, time).alias("_t"))
    y, t = F.when(finite("_y"), F.col("_y")), F.when(finite("_t"), F.col("_t"))
    return group_agg(f, by, F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
                     F.count(y).alias("n"), F.floor(F.min(t)).alias("first_time"), F.floor(F.max(t)).alias("last_time"))


def event_notes(df: DataFrame, outcome: str, time: str, events: DataFrame, window: int = 2) -> DataFrame:
    """Mean outcome in [event, event + window] against the overall mean.

    ``events`` has ``event_time`` (whole number) and ``event``. The facts are first reduced to one row per
    period; the window is then an equi-join on the periods an event covers.
    """
    f = clean_numeric(df, {"_y": outcome, "_t": time})
    per = f.groupBy("_t").agg(F.sum("_y").alias("_s"), F.count(F.lit(1)).alias("_n"))
    per = materialise(per)
    whole = per.agg((F.sum("_s") / F.sum("_n")).alias("_mean"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    floor = F.floor("_t").cast("long")
    covered = events.select("event_time", "event", F.explode(F.sequence(
        F.col("event_time").cast("long"), (F.col("event_time") + window).cast("long"))).alias("_p"))
    hit = per.withColumn("_p", floor).join(covered, "_p").where(
        F.col("_t").between(F.col("event_time"), F.col("event_time") + window))
    notes = hit.groupBy("event_time", "event").agg((F.sum("_s") / F.sum("_n")).alias("window_mean"), F.sum("_n").alias("window_rows"))
    rows = attach(notes, whole, []).where(F.col("event_time").between(F.col("_lo"), F.col("_hi")))
    dev = F.abs(F.col("window_mean") - F.col("_mean")) / (F.abs("_mean") + TINY) * 100
    return rows.select("event_time", "event", "window_mean", "window_rows", F.col("_mean").alias("overall_mean"), dev.alias("pct_deviation"),
                       F.when(F.col("window_mean") > F.col("_mean"), "above").otherwise("below").alias("direction"))


# --- outliers and insights -------------------------------------------------------------------------------

def outlier_rows(df: DataFrame, results: DataFrame, outcome: str, treatment: str, keys: Sequence[str],
                 by: Sequence[str] = (), sigmas: float = 2.0) -> DataFrame:
    """Rows further than ``sigmas`` residual standard deviations from the line (needs six rows)."""
    by = list(by)
    r = centroid_residuals(df, results, outcome, treatment, by, keys)
    spread = group_agg(r, by, F.stddev_pop("_e").alias("_sd"))
    spread = materialise(spread) if by else spread
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    out = attach(r, spread, by).where((F.col("_n") >= 6) & (F.abs("_e") > sigmas * sd))
    return out.select(*by, *[k for k in keys if k not in by], F.col("_e").alias("residual"), (F.col("_e") / sd).alias("z"))


def outlier_units(df: DataFrame, outcome: str, unit: str, by: Sequence[str] = (), sigmas: float = 1.5) -> DataFrame:
    """Units whose mean is further than ``sigmas`` sd from the mean of unit means."""
    by = list(by)
    means = clean_numeric(df, {"_y": outcome}, by, [unit]).groupBy(*by, unit).agg(F.avg("_y").alias("unit_mean"))
    means = materialise(means)
    c = group_agg(means, by, F.avg("unit_mean").alias("_m"), F.stddev_samp("unit_mean").alias("_s"), F.count(F.lit(1)).alias("_k"))
    away = F.abs(F.col("unit_mean") - F.col("_m")) > sigmas * F.col("_s")
    flagged = attach(means, c, by).where((F.col("_k") >= 3) & away)
    return flagged.select(*by, unit, "unit_mean", ((F.col("unit_mean") - F.col("_m")) / F.col("_s")).alias("z"))


def stronger_signal(df: DataFrame, outcome: str, treatment: str | None, columns: Sequence[str] | None = None,
                    by: Sequence[str] = (), least: float = 0.4) -> DataFrame:
    """The other numeric column with the largest |r| above ``least`` (more than two values, five pairs)."""
    by = list(by)
    columns = list(columns or [c for c in df.columns if is_numeric(df, c) and c not in (outcome, treatment, *by)])
    f = df.select(*by, as_double(df, outcome).alias("_o"), *[as_double(df, c).alias(c) for c in columns])
    here = lambda c: finite("_o") & finite(c)      # noqa: E731
    cells = [F.struct(F.lit(c).alias("column"), F.corr(F.when(here(c), F.col("_o")), F.when(here(c), F.col(c))).alias("r"),
                      F.count_if(here(c)).alias("n"), F.approx_count_distinct(c).alias("_u")) for c in columns]
    rows = group_agg(f, by, F.array(*cells).alias("_c")).select(*by, F.explode("_c").alias("_c")).select(*by, "_c.*")
    rows = rows.where((F.col("n") >= 5) & (F.col("_u") > 2) & (F.abs("r") > least))
    best = group_agg(rows, by, F.max_by(F.struct("column", "r", "n"), F.abs("r")).alias("_b")).where(F.col("_b").isNotNull())
    return best.select(*by, "_b.column", "_b.r", "_b.n")


def nonlinearity_hint(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Linear and quadratic R2 and whether the quadratic gains more than 0.05."""
    by = list(by)
    fit = regress.quadratic_fit(_xy(df, outcome, treatment, by), by)
    lin = F.greatest(F.lit(0.0), F.coalesce(ratio(F.col("_sdy") * F.col("_sdy"), F.col("_sdd") * F.col("_syy")), F.lit(0.0)))
    quad = F.greatest(F.lit(0.0), F.coalesce(1 - ratio(F.col("_rss"), F.col("_syy")), lin))
    return fit.select(*by, F.coalesce("_n", F.lit(0)).alias("n_obs"), lin.alias("r2_linear"), quad.alias("r2_quadratic"),
                      F.coalesce((F.col("_n") >= 15) & (quad - lin > 0.05) & (quad > 0.02), F.lit(False)).alias("nonlinear"))


def scale_mismatch(df: DataFrame, results: DataFrame, outcome: str, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Predictor mean over 1000 times the outcome mean together with a coefficient below 0.001."""
    by = list(by)
    f = df.select(*by, as_double(df, outcome).alias("_y"), as_double(df, treatment).alias("_x"))
    a = group_agg(f, by, F.avg(F.when(finite("_x"), F.col("_x"))).alias("x_mean"), F.avg(F.when(finite("_y"), F.col("_y"))).alias("y_mean"),
                  F.count_if(finite("_x")).alias("_nx"), F.count_if(finite("_y")).alias("_ny"))
    est = results.where(F.col("status") == "ok").select(*by, "estimate")
    out = attach(a, est if by else single(est), by)
    scale = F.abs("x_mean") / F.when(F.abs("y_mean") > 0, F.abs("y_mean")).otherwise(1.0)
    flag = (F.col("_nx") >= 5) & (F.col("_ny") >= 5) & (scale > 1000) & (F.abs("estimate") < 1e-3)
    return out.select(*by, "x_mean", "y_mean", scale.alias("scale_ratio"), F.coalesce(flag, F.lit(False)).alias("mismatch"))


MACRO_WORDS = ("gdp", "inflation", "unemployment", "cpi", "rate", "growth")     # fixed values


def mixed_frequency(df: DataFrame, results: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Median gap of at most five days on more than 50 stamps, a macro-named column and R2 below 0.01."""
    by = list(by)
    day = as_double(df, time) / 86400 if isinstance(dtype_of(df, time), DATELIKE[1:]) else as_double(df, time)
    f = df.select(*by, day.alias("_t")).where(finite("_t"))
    stamps = materialise(f.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("_k")))
    total = group_agg(stamps, by, F.sum("_k").alias("n_stamps"), F.count(F.lit(1)).alias("n_distinct"))
    gaps = Series.of(stamps, by, "_t").lag(_p=("_t", 1)).rows().where(F.col("_p").isNotNull()).select(
        *by, (F.col("_t") - F.col("_p")).alias("_gap"))
    mid = exact_quantile(gaps, "_gap", 0.5, by, "median_gap_days")
    out = attach(total, mid, by)
    r2 = results.where(F.col("status") == "ok").select(*by, "r_squared")
    out = attach(out, r2 if by else single(r2), by)
    macro = any(w in c.lower() for c in df.columns for w in MACRO_WORDS)
    flag = (F.col("n_stamps") > 50) & (F.col("median_gap_days") <= 5) & F.lit(macro) & (F.col("r_squared") < 0.01)
    return out.select(*by, "n_stamps", "n_distinct", "median_gap_days", F.lit(macro).alias("has_macro_column"),
                      F.coalesce(flag, F.lit(False)).alias("mixed"))


def no_signal(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R2 below 0.005, p above 0.4 and more than 200 rows."""
    flag = (F.coalesce("r_squared", F.lit(0.0)) < 0.005) & (F.coalesce("pvalue", F.lit(1.0)) > 0.4) & (F.col("n_obs") > 200)
    return results.select(*by, "model", "r_squared", "pvalue", "n_obs", flag.alias("no_signal"))


def low_variation(df: DataFrame, treatment: str, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient of variation of the predictor between 0 and 0.05 on more than five rows."""
    f = clean_numeric(df, {"_x": treatment}, by)
    a = group_agg(f, by, F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"))
    cv = F.when(F.abs("_m") > TINY, F.col("_s") / F.abs("_m")).otherwise(0.0)
    return a.select(*by, "n", cv.alias("cv"), F.coalesce((cv > 0) & (cv < 0.05) & (F.col("n") > 5), F.lit(False)).alias("low_variation"))


def insights(df: DataFrame, results: DataFrame, outcome: str, treatment: str, time: str | None = None,
             unit: str | None = None, law: DataFrame | None = None, limit: int = 7) -> DataFrame:
    """Findings in fixed order: law, outlier rows, outlier units, stronger signal, non-linearity, scale,
    frequency, no signal, low variation; the first ``limit`` that hold."""
    parts: list[DataFrame] = []

    def add(rank: int, kind: str, frame: DataFrame, when: Column, text: Column):
        parts.append(frame.where(when).select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), text.alias("heading")))

    if law is not None:
        add(1, "known_law", law, F.col("law").isNotNull(), F.col("law"))
    far = outlier_rows(df, results, outcome, treatment, []).agg(F.count(F.lit(1)).alias("k"))
    add(2, "outlier_rows", far, F.col("k") > 0, F.format_string("%d rows far from the line", "k"))
    if unit:
        odd = outlier_units(df, outcome, unit).agg(
            F.count(F.lit(1)).alias("k"), F.min(F.struct((-F.abs("z")).alias("z"), F.col(unit).cast("string").alias("u"))).alias("m"))
        add(3, "outlier_units", odd, F.col("k") > 0, F.format_string("%d units apart from the rest, first of all %s", "k", "m.u"))
    others = [c for c in df.columns if is_numeric(df, c) and c not in (outcome, treatment, unit)]
    if others:
        best = stronger_signal(df, outcome, treatment, others)
        add(4, "stronger_signal", best, F.lit(True), F.format_string("%s is closer to the outcome (r %+.2f)", "column", "r"))
    add(5, "nonlinear", nonlinearity_hint(df, outcome, treatment), F.col("nonlinear"), F.lit("a curve fits better than a line"))
    add(6, "scale_mismatch", scale_mismatch(df, results, outcome, treatment), F.col("mismatch"),
        F.format_string(f"{treatment} is %.0f times the size of {outcome}", "scale_ratio"))
    if time:
        add(7, "mixed_frequency", mixed_frequency(df, results, time), F.col("mixed"), F.lit("daily stamps beside slow macro figures"))
    add(8, "no_signal", no_signal(results), F.col("no_signal"), F.lit("many rows and no relation"))
    add(9, "low_variation", low_variation(df, treatment), F.col("low_variation"),
        F.format_string(f"{treatment} hardly varies (%.1f%% of its mean)", F.col("cv") * 100))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rank").limit(limit)

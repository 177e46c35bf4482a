import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspan.operators import diagnostics as D
from panelspan.operators import forecast as FC


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def series(spark, y, t=None):
    return frame(spark, y=np.asarray(y, float), t=np.arange(len(y), dtype=float) if t is None else t)


@pytest.fixture(scope="module")
def wave():
    t = np.arange(20)
    return 10 + 0.7 * t + np.sin(t / 2)


def path(df):
    return df.orderBy("h").toPandas()


def test_random_walk_and_trend(spark, wave):
    df = series(spark, wave, 2000 + 2.0 * np.arange(20))
    r = path(FC.forecast_random_walk(df, "y", "t", 3))
    assert list(r["time"]) == [2040.0, 2042.0, 2044.0] and (r["forecast"] == wave[-1]).all()
    rmse = np.sqrt(np.mean(np.diff(wave) ** 2))
    np.testing.assert_allclose(r["ci_upper"] - r["forecast"], 1.96 * rmse * np.sqrt([1, 2, 3]))
    b = np.polyfit(np.arange(20), wave, 1)
    np.testing.assert_allclose(path(FC.forecast_linear_trend(df, "y", "t", 3))["forecast"], np.polyval(b, [20, 21, 22]), rtol=1e-9)


def test_ar1_iterates_its_own_forecast(spark, wave):
    b, a = np.polyfit(wave[:-1], wave[1:], 1)
    want, last = [], wave[-1]
    for _ in range(4):
        last = a + b * last
        want.append(last)
    np.testing.assert_allclose(path(FC.forecast_ar1(series(spark, wave), "y", "t", 4))["forecast"], want, rtol=1e-8)


@pytest.mark.parametrize("limits", [{}, {"max_series_rows": 6, "chunk": 4}])
def test_smoothing_equals_the_plain_recursion(spark, wave, limits):
    best = None
    for alpha in FC.ALPHAS:
        level, sse = wave[0], 0.0
        for y in wave[1:]:
            sse += (y - level) ** 2
            level += alpha * (y - level)
        best = min(best or (np.inf,), (sse, alpha, level))
    r = path(FC.forecast_exp_smoothing(series(spark, wave), "y", "t", 2, **limits))
    assert r["alpha"][0] == pytest.approx(best[1]) and r["forecast"][1] == pytest.approx(best[2], rel=1e-9)
    assert r["rmse"][0] == pytest.approx(np.sqrt(best[0] / 19), rel=1e-9)


def test_short_series_give_error_rows(spark):
    r = path(FC.forecast_random_walk(series(spark, [1.0, 2.0]), "y", "t", 3))
    assert len(r) == 1 and r["status"][0] == "error"


def test_arima_recovers_known_processes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(2):
        e, y = rng.normal(size=500), np.zeros(500)
        for t in range(1, 500):
            y[t] = 0.7 * y[t - 1] + e[t]
        y = np.cumsum(y) if s else y
        rows += [(s, float(t), float(v)) for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "s int, t double, y double")
    got = {r["s"]: r for r in FC.forecast_arima(df, "y", "t", 3, ["s"]).where("h = 1").collect()}
    assert got[0]["d"] == 0 and got[1]["d"] == 1
    assert all(0.9 < r["rmse"] < 1.1 and r["ci_lower"] < r["forecast"] < r["ci_upper"] for r in got.values())
    ar1 = FC._fit_batch(np.array([[r[2] for r in rows[:500]]]), np.array([500]), np.array([1]), np.array([0]), np.array([True]), np.array([4]))[0]
    assert ar1[0, 1] == pytest.approx(0.7, abs=0.08)


def test_arima_in_stretches_is_the_fit_of_the_whole(spark):
    """Moving-average, mixed and integrated series: orders, errors and forecasts do not depend on what one task holds."""
    rng, n, rows = np.random.default_rng(5), 900, []
    for s in range(3):
        e, y = rng.normal(size=n), np.zeros(n)
        for t in range(3, n):
            y[t] = (0.6 * y[t - 1] if s else 0.0) + e[t] + (0.9 * e[t - 1] if s < 2 else -0.5 * e[t - 1] + 0.3 * e[t - 2])
        rows += [(f"s{s}", float(t), float(v)) for t, v in enumerate(np.cumsum(y) if s == 2 else y + 10)]
    rows += [("short", float(t), float(rng.normal())) for t in range(40)] + [("flat", float(t), 3.0) for t in range(300)]
    df = spark.createDataFrame(rows, "s string, t double, y double").repartition(3)
    whole = {r["s"]: r for r in FC.forecast_arima(df, "y", "t", 3, ["s"]).where("h = 3").collect()}
    cut = {r["s"]: r for r in FC.forecast_arima(df, "y", "t", 3, ["s"], fit_rows=200, fit_before=400, max_series_rows=350).where("h = 3").collect()}
    assert set(whole) == set(cut) == {"s0", "s1", "s2", "short", "flat"}
    for s, w in whole.items():
        c = cut[s]
        assert [c[k] for k in ("n_obs", "status", "engine")] == [w[k] for k in ("n_obs", "status", "engine")], s
        if s == "s0":       # orders beyond the process have a flat optimum: where the steps on it end may differ, not what it is worth
            assert c["aic"] == pytest.approx(w["aic"], abs=2.0) and c["rmse"] == pytest.approx(w["rmse"], rel=5e-3)
            continue
        assert [c[k] for k in "pdq"] == [w[k] for k in "pdq"], s
        for k in ("aic", "rmse", "forecast", "ci_lower"):
            assert c[k] == pytest.approx(w[k], rel=1e-5, abs=1e-4), (s, k)
    assert whole["s0"]["q"] > 0 and cut["s0"]["q"] > 0


def _plain_w(x):
    """W with the whole vector of weights."""
    from panelspan.functions.dist import norm_ppf
    x, n = np.sort(x), len(x)
    m = norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    u, total = n ** -0.5, m @ m
    outer = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u) + m[-1] / np.sqrt(total)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) + m[-2] / np.sqrt(total)
    a = m / np.sqrt((total - 2 * m[-1] ** 2 - (2 * m[-2] ** 2 if n > 5 else 0)) / (1 - 2 * outer ** 2 - (2 * second ** 2 if n > 5 else 0)))
    a[[0, -1]] = -outer, outer
    if n > 5:
        a[[1, -2]] = -second, second
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def test_shapiro_of_all_residuals(spark):
    rng = np.random.default_rng(6)
    groups = {"published": np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]), "normal": rng.normal(size=7000) + 1e6,
              "skewed": rng.exponential(size=6000), "ties": rng.integers(0, 5, 400).astype(float), "five": rng.normal(size=5),
              "three": np.array([1.0, 2.0, 9.0]), "two": np.array([1.0, 2.0]), "flat": np.full(30, 2.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("ties", None)]
    df = spark.createDataFrame(rows, "g string, _e double").repartition(7)
    for limit in (None, 900):
        got = {r["g"]: r for r in D.shapiro_wilk(df, ["g"], max_series_rows=limit).collect()}
        assert set(got) == set(groups) and got["two"]["status"] == got["flat"]["status"] == "not_run"
        for g in ("published", "normal", "skewed", "ties", "five"):
            assert got[g]["statistic"] == pytest.approx(_plain_w(groups[g]), rel=1e-8) and got[g]["detail"]["n_used"] == len(groups[g])
        assert got["published"]["statistic"] == pytest.approx(0.79, abs=0.005) and got["published"]["pvalue"] == pytest.approx(0.0067, abs=0.0005)
        assert got["three"]["statistic"] == pytest.approx(0.5 * 8 ** 2 / 38, rel=1e-9)
        assert got["normal"]["status"] == "ok" and got["skewed"]["status"] == "violated"
    assert D.shapiro_wilk(df.where("g = 'five'").drop("g")).first()["statistic"] == pytest.approx(_plain_w(groups["five"]), rel=1e-9)
    assert D.shapiro_wilk(df.limit(0).drop("g")).first()["status"] == "not_run"


@pytest.fixture(scope="module")
def walk():
    return np.cumsum(np.random.default_rng(7).normal(size=120))


def _adf(y, lag, first):
    n = len(y)
    d = np.diff(y)
    rows = range(first - 1, n - 1)
    X = np.array([[1, y[i], *[d[i - k] for k in range(1, lag + 1)]] for i in rows])
    z = d[list(rows)]
    b = np.linalg.lstsq(X, z, rcond=None)[0]
    e = z - X @ b
    s2 = e @ e / (len(z) - X.shape[1])
    aic = len(z) * (np.log(2 * np.pi * e @ e / len(z)) + 1) + 2 * X.shape[1]
    return b[1] / np.sqrt(s2 * np.linalg.inv(X.T @ X)[1, 1]), aic


@pytest.mark.parametrize("limit", [None, 17])
def test_unit_root_lag_by_aic(spark, walk, limit):
    most = int(np.ceil(12 * (120 / 100) ** 0.25))
    lag = min(range(most + 1), key=lambda k: _adf(walk, k, most + 1)[1])
    s = series(spark, walk).select(F.col("t").alias("_t"), F.col("y").alias("_y"))
    r = D.adf_test(s, max_series_rows=limit).first()
    assert r["detail"]["lag"] == lag
    assert r["statistic"] == pytest.approx(_adf(walk, lag, lag + 1)[0], rel=1e-7)
    assert r["status"] == "violated" and r["pvalue"] > 0.05


def test_unit_root_of_a_long_series_looks_at_all_its_lags(spark):
    """70,000 periods have 62 candidate lags; one factorisation by hand gives all their residual sums."""
    n, rng = 70_000, np.random.default_rng(11)
    e = rng.normal(size=n + 70)
    y = np.cumsum(e[70:] + 0.5 * e[9:-61] + 0.4 * e[:-70])[:n] + 1e4        # changes that depend on those 61 and 70 steps before
    most = int(np.ceil(12 * (n / 100) ** 0.25))
    assert most == 62

    def design(lag, first):
        d, at = np.diff(y), np.arange(first - 1, n - 1)
        return np.column_stack([np.ones(len(at)), y[at] - y.mean(), *[d[at - k] for k in range(1, lag + 1)], d[at]])

    r = np.linalg.qr(design(most, most + 1), mode="r")
    m = n - most - 1
    aic = [m * (np.log(2 * np.pi * (r[k:, -1] ** 2).sum() / m) + 1) + 2 * k for k in range(2, most + 3)]
    lag = int(np.argmin(aic))
    assert lag >= 61
    X = design(lag, lag + 1)
    X, z = X[:, :-1], X[:, -1]
    b = np.linalg.lstsq(X, z, rcond=None)[0]
    want = b[1] / np.sqrt(((z - X @ b) ** 2).sum() / (len(z) - X.shape[1]) * np.linalg.inv(X.T @ X)[1, 1])
    s = spark.createDataFrame(pd.DataFrame({"_t": np.arange(n), "_y": y})).repartition(7)
    for chunk, limit in ((20_000, None), (64, 9000)):
        got = D.adf_test(s, max_series_rows=limit, chunk=chunk).first()
        assert got["detail"]["lag"] == lag and got["detail"]["n_used"] == len(z) and got["statistic"] == pytest.approx(want, rel=1e-6)


def test_unit_root_of_odd_series(spark):
    rows = [("short", float(i), float(i)) for i in range(3)] + [("flat", float(i), 5.0) for i in range(40)] + [("line", float(i), 2.0 * i) for i in range(40)]
    rows += [("noise", float(i), float(v)) for i, v in enumerate(np.random.default_rng(3).normal(size=60))] + [("noise", 60.0, None)]
    s = spark.createDataFrame(rows, "g string, _t double, _y double")
    got = {r["g"]: r for r in D.adf_test(s, ["g"]).collect()}
    assert set(got) == {"short", "flat", "line", "noise"} and got["short"]["status"] == "not_run" and got["noise"]["status"] == "ok"
    alone = D.adf_test(s.where("g = 'noise'").drop("g")).first()
    assert alone["statistic"] == pytest.approx(got["noise"]["statistic"], rel=1e-9) and alone["detail"] == got["noise"]["detail"]
    assert D.adf_test(s.limit(0), ["g"]).collect() == [] and D.adf_test(s.limit(0).drop("g")).first()["status"] == "not_run"


def test_unit_root_p_value_self_check(spark):
    rows = {r["t"]: r["p"] for r in spark.createDataFrame([(-2.86,), (-3.43,), (-1.61,), (-1.6099999,), (-30.0,), (3.0,)], "t double")
            .withColumn("p", D.unit_root_pvalue(F.col("t"))).collect()}
    assert rows[-2.86] == pytest.approx(0.05, abs=0.001) and rows[-3.43] == pytest.approx(0.01, abs=0.001)
    assert rows[-1.61] == pytest.approx(rows[-1.6099999], abs=2e-3) and rows[-30.0] == 0.0 and rows[3.0] == 1.0


def test_stationarity_detects_the_walk(spark, walk):
    s = series(spark, walk).select(F.col("t").alias("_t"), F.col("y").alias("_y"))
    a, b = D.kpss_test(s).first(), D.kpss_test(s, max_series_rows=11).first()
    assert a["status"] == "violated" and a["statistic"] == pytest.approx(b["statistic"], rel=1e-9)


def test_changes_never_cross_units(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -1.0), ("b", 1, 1.0), ("b", 2, -1.0)], "u string, t int, _e double")
    assert D.durbin_watson(df, "t", ["u"]).first()["statistic"] == pytest.approx(2.0)


def test_parallel_trends_equals_the_interaction_regression(spark):
    rng = np.random.default_rng(1)
    rows = [(u, t, int(u == "A" and t >= 2018), float((0.8 if u == "A" else 0.1) * (t - 2010) + 0.1 * rng.normal()))
            for u in ("A", "B") for t in range(2010, 2022)]
    r = D.parallel_trends(spark.createDataFrame(rows, "u string, t int, d int, y double"), "y", "d", "t", "u").first()
    pre = [x for x in rows if x[1] < 2018]
    t, g, y = (np.array(v, float) for v in ([x[1] - 2010 for x in pre], [x[0] == "A" for x in pre], [x[3] for x in pre]))
    X = np.c_[np.ones(len(y)), t, g, t * g]
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    s2 = ((y - X @ b) ** 2).sum() / (len(y) - 4)
    assert r["status"] == "violated" and r["statistic"] == pytest.approx(b[3], rel=1e-9)
    assert r["detail"]["interaction_se"] == pytest.approx(np.sqrt(s2 * np.linalg.inv(X.T @ X)[3, 3]), rel=1e-9)
    none = D.parallel_trends(spark.createDataFrame([(u, t, 0, 1.0 * t) for u in "AB" for t in range(9)], "u string, t int, d int, y double"),
                             "y", "d", "t", "u").first()
    assert none["status"] == "not_run"


def test_suite_drops_the_difference_check_when_the_level_is_fine(spark):
    y = np.random.default_rng(3).normal(size=80)
    ids = [r["check_id"] for r in D.arima_diagnostics(series(spark, y), "y", "t").collect()]
    assert ids == ["adf", "kpss", "ljung_box", "jarque_bera"]


def test_arima_suite_looks_at_the_changes_of_a_wandering_level(spark, walk):
    rows = D.arima_diagnostics(series(spark, walk), "y", "t").collect()
    got = {r["check_id"]: r for r in rows}
    assert [r["check_id"] for r in rows] == ["adf", "adf_diff", "kpss", "ljung_box", "jarque_bera"]
    changes = np.diff(walk)
    most = int(np.ceil(12 * (119 / 100) ** 0.25))
    lag = min(range(most + 1), key=lambda k: _adf(changes, k, most + 1)[1])
    assert got["adf"]["status"] == "violated" and got["adf_diff"]["status"] == "ok"
    assert got["adf_diff"]["detail"]["lag"] == lag and got["adf_diff"]["statistic"] == pytest.approx(_adf(changes, lag, lag + 1)[0], rel=1e-7)


def test_degenerate_series_do_not_stop_the_others(spark):
    """A straight line, a constant and one jump beside a noisy series: every series gets its rows."""
    rng = np.random.default_rng(5)
    values = {"line": np.arange(40.0), "flat": np.full(40, 3.0), "jump": np.r_[np.zeros(20), np.ones(20)], "noise": rng.normal(size=40).cumsum(), "short": np.arange(5.0)}
    df = spark.createDataFrame([(k, t, float(v)) for k, ys in values.items() for t, v in enumerate(ys)], "g string, t int, y double")
    got = FC.forecast_arima(df, "y", "t", 3, ["g"]).groupBy("g").count().collect()
    assert {r["g"] for r in got} == set(values)


def test_inflation_of_constant_columns_is_null(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i * i)) for i in range(20)], "a double, b double, c double")
    got = {r["column"]: r["vif"] for r in D.vif(df, ["a", "b", "c"]).collect()}
    assert got["b"] is None and got["a"] > 5 and got["c"] > 5
    assert all(r["vif"] is None for r in D.vif(df.limit(0), ["a", "b"]).collect())


def test_normality_is_the_same_for_any_partitions(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(v),) for v in rng.exponential(size=500)], "_e double")
    one, many = (D.jarque_bera(df.repartition(n)).first() for n in (1, 7))
    assert one["status"] == many["status"] == "violated" and one["statistic"] == pytest.approx(many["statistic"], rel=1e-9)
    assert D.jarque_bera(df.limit(0)).first()["status"] == "not_run"


def test_comparison_ranks_the_rows_of_all_four_models(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(t), float(5 + 0.3 * t * (g == "a") + np.sin(t) + rng.normal())) for g in "ab" for t in range(40)]
    df = spark.createDataFrame(rows, "g string, t double, y double")
    got = {(r["g"], r["model"]): r for r in FC.forecast_compare(df, "y", "t", 3, ["g"]).collect()}
    assert len(got) == 8
    for name, fn in FC.MODELS.items():
        for r in fn(df, "y", "t", 3, ["g"]).where("h = 1").collect():
            c = got[r["g"], name]
            assert c["rmse"] == pytest.approx(r["rmse"], rel=1e-9) and c["next_forecast"] == pytest.approx(r["forecast"], rel=1e-9) and c["n_obs"] == r["n_obs"] == 40
    for g in "ab":
        order = sorted((c for (k, _), c in got.items() if k == g), key=lambda c: c["rank"])
        assert [c["rank"] for c in order] == [1, 2, 3, 4] and [c["rmse"] for c in order] == sorted(c["rmse"] for c in order)
        assert all(c["vs_random_walk"] == pytest.approx(c["rmse"] / got[g, "random_walk"]["rmse"]) for c in order)


def test_arima_suite_shows_what_its_sql_shows(spark):
    """On these orders a unit root statistic of -9.6901147 is -9.690115 to six places, and from there -9.69012 to five."""
    import duckdb
    from panelspan import catalog
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{small}/orders.parquet'")
    want = con.execute(catalog.ORACLES["arima_diagnostics"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["arima_diagnostics"](spark, small).collect())) == sorted(want)


def test_start_values_of_many_series_at_once():
    """Series of different length and order, one of them flat, get the values of two plain regressions each."""
    rng = np.random.default_rng(8)
    sizes, orders = np.array([31, 24, 27, 31, 20]), [(1, 0, True), (2, 2, True), (0, 3, False), (3, 1, False), (1, 1, True)]
    w = np.zeros((5, 31))
    for row, n in zip(w, sizes):
        row[:n] = rng.normal(size=n) + 5
    w[4, :20] = 2.0
    p, q, c = (np.array(v) for v in zip(*orders))
    got = FC._arma_start(w, sizes, p, q, c)
    for y, n, (p, q, c), row in zip(w, sizes, orders, got):
        y, long = y[:n], max(1, min(n // 4, p + q + 5))
        x = np.column_stack([np.ones(n - long), *[y[long - i:n - i] for i in range(1, long + 1)]])
        e = np.append(np.zeros(long), y[long:] - x @ np.linalg.lstsq(x, y[long:], rcond=None)[0])
        m = long + q if q else p
        x = np.column_stack([np.ones(n - m)] * c + [y[m - i:n - i] for i in range(1, p + 1)] + [e[m - i:n - i] for i in range(1, q + 1)])
        want = np.linalg.lstsq(x, y[m:], rcond=None)[0]
        assert np.allclose(row[np.r_[0:int(c), 1:1 + p, 4:4 + q]], want, rtol=1e-8, atol=1e-8)


def test_only_lag_polynomials_near_the_circle_are_scaled():
    rng = np.random.default_rng(9)
    coef = rng.normal(size=(500, 3)) * rng.uniform(0, 1.5, size=(500, 1))
    top = np.array([np.max(np.abs(np.roots([1.0, *-c]))) for c in coef])
    assert (FC._inside(coef)[top < 0.98 - 1e-6] == coef[top < 0.98 - 1e-6]).all() and not FC._within(coef, 0.98)[top > 0.98].any()
    assert FC._within(coef, 0.98)[top < 0.98 - 1e-6].all()

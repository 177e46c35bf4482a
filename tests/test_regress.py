import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspan.operators import median as M
from panelspan.operators import panel as P
from panelspan.operators import regress as R


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def one(df):
    return df.first().asDict()


def by_hand(y, X):
    """Coefficients and HC1 covariance with explicit matrices."""
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    inv = np.linalg.inv(X.T @ X)
    n, k = X.shape
    return beta, n / (n - k) * inv @ (X * e[:, None] ** 2).T @ X @ inv, e


@pytest.fixture(scope="module")
def line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=100) + 1e4
    return x, 2 + 3 * x + rng.normal(size=100) * (0.5 + np.abs(x - 1e4))


def test_ols_matches_matrices_and_ignores_order(spark, line):
    x, y = line
    beta, v, e = by_hand(y, np.c_[np.ones(100), x])
    df = frame(spark, y=y, x=x)
    r = one(R.ols(df, "y", "x"))
    assert r["estimate"] == pytest.approx(beta[1], rel=1e-6)
    assert r["se"] == pytest.approx(np.sqrt(v[1, 1]), rel=1e-6)
    assert r["r_squared"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    assert r["ci_upper"] - r["ci_lower"] == pytest.approx(2 * 1.96 * r["se"])
    assert r["pvalue"] < 0.001 and r["significant"]
    again = one(R.ols(df.repartition(7).orderBy("x"), "y", "x"))
    assert again["estimate"] == pytest.approx(r["estimate"], rel=1e-12)


def test_groups_give_the_same_as_separate_fits(spark, line):
    x, y = line
    g = np.where(np.arange(100) % 3 == 0, "hot", "b")
    df = frame(spark, y=y, x=x, g=g)
    rows = {r["g"]: r for r in R.ols(df, "y", "x", ["g"]).collect()}
    for name in ("hot", "b"):
        alone = one(R.ols(df.where(F.col("g") == name), "y", "x"))
        assert rows[name]["estimate"] == pytest.approx(alone["estimate"], rel=1e-9)
        assert rows[name]["se"] == pytest.approx(alone["se"], rel=1e-9)


def test_text_nan_and_infinity_are_dropped(spark):
    df = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.5), ("4", 4.0), ("5", 5.5), ("abc", 6.0), ("7", float("nan")),
                                ("8", float("inf")), (None, 9.0)], "y string, x double")
    assert one(R.ols(df, "y", "x"))["n_obs"] == 5


def test_error_rows(spark):
    few = one(R.ols(frame(spark, y=[1.0, 2.0], x=[1.0, 2.0]), "y", "x"))
    assert few["status"] == "error" and few["error"] == "too few rows (2)" and few["model"] == "ols"
    assert few["estimate"] is None and few["n_obs"] == 2
    flat = one(R.ols(frame(spark, y=np.arange(9.0), x=np.ones(9)), "y", "x"))
    assert flat["status"] == "error"


def test_log_models(spark, line):
    x, _ = line
    x = x - 9990
    y = np.exp(0.3 + 0.05 * x)
    r = one(R.log_linear(frame(spark, y=y, x=x), "y", "x"))
    assert r["estimate"] == pytest.approx(0.05, rel=1e-8)
    assert r["extra"]["semi_elasticity_percent"] == pytest.approx(100 * np.expm1(0.05), rel=1e-8)
    r = one(R.log_log(frame(spark, y=7 * x ** 1.5, x=x), "y", "x"))
    assert r["estimate"] == pytest.approx(1.5, rel=1e-8)


def test_quadratic_matches_matrices(spark):
    rng = np.random.default_rng(123)
    x = np.linspace(1, 10, 80)
    y = 5 + 2 * x + 0.2 * x ** 2 + rng.normal(size=80)
    beta, v, _ = by_hand(y, np.c_[np.ones(80), x, x ** 2])
    g = np.array([0, 1, 2 * x.mean()])
    r = one(R.polynomial_ols(frame(spark, y=y, x=x), "y", "x"))
    assert r["estimate"] == pytest.approx(g @ beta, rel=1e-7)
    assert r["se"] == pytest.approx(np.sqrt(g @ v @ g), rel=1e-6)
    assert r["extra"]["linear_term"] == pytest.approx(beta[1], rel=1e-6)
    assert r["intercept"] == pytest.approx(beta[0], rel=1e-6)
    assert r["significant"]


def least_loss(x, y):
    return min(np.abs(y - y[i] - (y[j] - y[i]) / (x[j] - x[i]) * (x - x[i])).sum() for i in range(len(x)) for j in range(i) if x[i] != x[j])


def test_median_regression_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=41) * 3
    y = 1 + 2 * x + rng.standard_t(2, size=41)
    for by in ([], ["g"]):
        r = one(M.median_quantile(frame(spark, y=y, x=x, g=["a"] * 41), "y", "x", by))
        assert r["extra"]["loss"] <= least_loss(x, y) * (1 + 1e-12) and r["converged"] and r["n_iter"] == 1
        e = y - r["intercept"] - r["estimate"] * x
        assert r["se"] == pytest.approx(1.4826 * np.median(np.abs(e - np.median(e))) / np.sqrt(((x - x.mean()) ** 2).sum()), rel=1e-9)
        assert r["r_squared"] == pytest.approx(1 - least_loss(x, y) / np.abs(y - np.median(y)).sum(), rel=1e-9)


def test_best_line_of_ties_repeats_and_pulls():
    rng = np.random.default_rng(7)
    for trial in range(150):
        n = int(rng.integers(2, 30))
        u, z = rng.integers(-3, 4, n).astype(float), rng.integers(-4, 5, n).astype(float)
        if len(set(u)) == 1:
            continue
        w = rng.integers(1, 5, n).astype(float)
        c, s, inner = M.best_line(u, z, w, (0.0, 0.0), tuple(rng.normal(size=2)), None)
        lines = [(z[i] - (z[j] - z[i]) / (u[j] - u[i]) * u[i], (z[j] - z[i]) / (u[j] - u[i])) for i in range(n) for j in range(n) if u[i] != u[j]]
        assert inner and w @ np.abs(z - c - s * u) <= min(w @ np.abs(z - a - b * u) for a, b in lines) + 1e-9, trial
        # Rows that are far off, as a pull, do what the rows themselves do.
        far_u, far_z = rng.normal(size=6), rng.choice([-1, 1], 6) * 1e3
        got = M.best_line(u, z, w, (np.sign(far_z).sum(), (np.sign(far_z) * far_u).sum()), (0.0, 0.0), 50.0)
        want = M.best_line(np.append(u, far_u), np.append(z, far_z), np.append(w, np.ones(6)), (0.0, 0.0), (0.0, 0.0), None)
        loss = lambda l: w @ np.abs(z - l[0] - l[1] * u) + np.abs(far_z - l[0] - l[1] * far_u).sum()
        if got[2] and max(map(abs, want[:2])) < 50:
            assert abs(loss(got) - loss(want)) < 1e-6, trial


@pytest.mark.parametrize("by", [[], ["g"]])
def test_median_regression_is_the_same_whatever_a_task_holds(spark, by):
    rng = np.random.default_rng(4)
    x = rng.normal(size=6000) * 3
    skewed = rng.exponential(size=6000) ** 2          # the mean line is a bad start
    df = frame(spark, y=1e6 + 2 * x + skewed * (1 + np.abs(x)), x=x, g=np.where(np.arange(6000) % 3 == 0, "a", "b")).repartition(5)
    key = lambda r: r["g"] if by else 0     # noqa: E731
    exact = {key(r): r for r in M.median_quantile(df, "y", "x", by).collect()}
    for points in (1500, 150):
        got = M.median_quantile(df, "y", "x", by, points=points).collect()
        assert len(got) == len(exact)
        for r in got:
            want = exact[key(r)]
            assert r["converged"] and r["n_iter"] > 1 and want["n_iter"] == 1
            for c in ("estimate", "intercept", "se", "r_squared", "pvalue"):
                assert r[c] == pytest.approx(want[c], rel=1e-9, abs=1e-12)


def test_median_regression_of_odd_groups(spark):
    n = 400
    x = np.arange(n, dtype=float)
    rows = [("line", 3.0 * a + 1, a) for a in x.tolist()] + [("most", 3.0 * a + (50.0 if i % 5 == 0 else 0.0), a) for i, a in enumerate(x.tolist())]
    rows += [("few", float(i), float(i)) for i in range(7)] + [("flat", float(i), 2.0) for i in range(20)] + [("few", None, 1.0)]
    rows += [("repeats", 2.0 * (i % 3), float(i % 3)) for i in range(900)] + [("repeats", 100.0, 2.0)] * 5
    df = spark.createDataFrame(rows, "g string, y double, x double")
    for points in (50_000, 40):
        got = {r["g"]: r for r in M.median_quantile(df, "y", "x", ["g"], points=points).collect()}
        assert set(got) == {"line", "most", "few", "flat", "repeats"}
        assert got["few"]["error"].startswith("too few rows (7") and got["flat"]["error"] == "the predictor does not vary"
        for g, slope in (("line", 3), ("most", 3), ("repeats", 2)):
            assert got[g]["estimate"] == pytest.approx(slope, rel=1e-9) and got[g]["converged"], (g, points)
    assert M.median_quantile(df.limit(0), "y", "x", ["g"]).collect() == []
    assert one(M.median_quantile(df.limit(0), "y", "x"))["error"].startswith("too few rows (0")


def dummies(v):
    return (np.asarray(v)[:, None] == np.unique(v)[None, :]).astype(float)


@pytest.fixture(scope="module")
def ragged():
    """Unbalanced panel with repeated rows and one unit holding a third of them."""
    rng = np.random.default_rng(5)
    u = np.concatenate([np.zeros(60, int), rng.integers(1, 7, 120)])
    t = rng.integers(0, 6, 180)
    x = rng.normal(size=180) + u + 0.3 * t
    return u, t, x, 1.5 * x + 2 * u - t + rng.normal(size=180)


def test_entity_effects_equal_dummies(spark, ragged):
    u, t, x, y = ragged
    beta = np.linalg.lstsq(np.c_[x, dummies(u)], y, rcond=None)[0]
    r = one(R.entity_fe(frame(spark, y=y, x=x, u=u), "y", "x", "u"))
    assert r["estimate"] == pytest.approx(beta[0], rel=1e-9)
    xd = x - np.array([x[u == k].mean() for k in u])
    e = y - np.c_[x, dummies(u)] @ beta
    g = len(np.unique(u))
    meat = sum((xd[u == k] @ e[u == k]) ** 2 for k in np.unique(u))
    assert r["se"] == pytest.approx(np.sqrt(g / (g - 1) * meat) / (xd @ xd), rel=1e-8)
    assert r["df"] == g - 1


def test_time_effects_equal_dummies(spark, ragged):
    u, t, x, y = ragged
    beta = np.linalg.lstsq(np.c_[x, dummies(t)], y, rcond=None)[0]
    r = one(R.time_fe(frame(spark, y=y, x=x, t=t), "y", "x", "t"))
    assert r["estimate"] == pytest.approx(beta[0], rel=1e-9)
    xd = x - np.array([x[t == k].mean() for k in t])
    e = y - np.c_[x, dummies(t)] @ beta
    assert r["se"] == pytest.approx(np.sqrt(180 / 179 * (xd ** 2 @ e ** 2)) / (xd @ xd), rel=1e-8)


@pytest.mark.parametrize("periods", [1000, 3])
def test_two_way_effects_equal_dummies_on_a_ragged_panel(spark, ragged, monkeypatch, periods):
    """By one sum of products of periods, and in steps."""
    monkeypatch.setattr(P, "PERIODS", periods)
    u, t, x, y = ragged
    full = np.c_[x, dummies(u), dummies(t)]
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    r = one(P.panel_ols(frame(spark, y=y, x=x, u=u, t=t), "y", "x", "t", "u"))
    assert r["converged"] and (r["n_iter"] == 1) == (periods == 1000)
    assert r["estimate"] == pytest.approx(beta[0], rel=1e-8)
    e = y - full @ beta
    rest = np.c_[dummies(u), dummies(t)]
    xd = x - rest @ np.linalg.lstsq(rest, x, rcond=None)[0]
    g = len(np.unique(u))
    meat = sum((xd[u == k] @ e[u == k]) ** 2 for k in np.unique(u))
    assert r["se"] == pytest.approx(np.sqrt(g / (g - 1) * meat) / (xd @ xd), rel=1e-6)


def test_two_way_groups_may_be_solved_either_way(spark, monkeypatch):
    """One group of few periods and one of many; units and cells that Arrow batches and blocks of units cut anywhere."""
    monkeypatch.setattr(P, "PERIODS", 5)
    monkeypatch.setattr(P, "UNITS", 3)
    rng, rows = np.random.default_rng(8), []
    for g, periods, units in (("few", 4, 20), ("many", 7, 9)):
        for u in range(units):
            for t in range(periods):
                if rng.random() < 0.7:
                    x = rng.normal() + 0.2 * u
                    rows += [(g, u, t, 3 * x + u - t + rng.normal(), x)] * int(rng.integers(1, 3))
    got = {r["g"]: r for r in P.panel_ols(spark.createDataFrame(rows, "g string, u int, t int, y double, x double"), "y", "x", "t", "u", by=["g"]).collect()}
    for g in ("few", "many"):
        part = np.array([r[1:] for r in rows if r[0] == g])
        want = np.linalg.lstsq(np.c_[part[:, 3], dummies(part[:, 0]), dummies(part[:, 1])], part[:, 2], rcond=None)[0][0]
        assert got[g]["status"] == "ok" and got[g]["converged"] and got[g]["estimate"] == pytest.approx(want, rel=1e-8)
    assert got["few"]["n_iter"] == 1 and got["many"]["n_iter"] > 1


def test_additive_predictor_leaves_nothing_to_estimate(spark):
    rows = [(u, 2000 + t, u + 1.5 * (t + 1 + u) + 0.1 * t, float(t + 1 + u)) for u in range(4) for t in range(8)]
    df = spark.createDataFrame(rows, "u int, t int, y double, x double")
    r = one(P.panel_ols(df, "y", "x", "t", "u"))
    assert r["status"] == "error" and "wholly" in r["error"] and r["model"] == "panel_ols"
    assert one(R.entity_fe(df, "y", "x", "u"))["status"] == "ok"
    assert one(R.time_fe(df, "y", "x", "t"))["status"] == "ok"


def test_difference_in_differences_recovers_the_effect(spark):
    rng = np.random.default_rng(3)
    rows = [(u, t, int(u == "A" and t >= 2015), float(k + 0.2 * t + 2.5 * (u == "A" and t >= 2015) + rng.normal() * 0.2))
            for k, u in enumerate("ABC") for t in range(2008, 2020)]
    df = spark.createDataFrame(rows, "u string, t int, d int, y double")
    r = one(P.diff_in_diff(df, "y", "d", "t", "u"))
    assert 1.5 < r["estimate"] < 3.5 and r["model"] == "diff_in_diff"


def test_first_difference_equals_within_for_two_periods(spark):
    rng = np.random.default_rng(9)
    u, t = np.repeat(np.arange(12), 2), np.tile([0, 1], 12)
    x = rng.normal(size=24)
    y = 0.7 * x + u + 0.5 * t + rng.normal(size=24) * 0.1
    df = frame(spark, u=u, t=t, x=x, y=y)
    fd, tw = one(R.first_difference(df, "y", "x", "t", "u")), one(P.panel_ols(df, "y", "x", "t", "u"))
    assert fd["estimate"] == pytest.approx(tw["estimate"], rel=1e-8)
    assert fd["n_units"] == 12 and fd["n_obs"] == 12


def test_long_series_are_cut_without_changing_results(spark, ragged):
    u, t, x, y = ragged
    df = frame(spark, y=y, x=x, u=np.zeros(180, int), t=np.arange(180.0))
    a, b = (one(R.first_difference(df, "y", "x", "t", "u", max_series_rows=m)) for m in (None, 13))
    assert a["n_obs"] == b["n_obs"] == 179
    assert a["estimate"] == pytest.approx(b["estimate"], rel=1e-12) and a["n_units"] == b["n_units"] == 1


def test_clustered_errors_match_matrices(spark, ragged):
    u, _, x, y = ragged
    X = np.c_[np.ones(180), x]
    beta, _, e = by_hand(y, X)
    inv = np.linalg.inv(X.T @ X)
    s = np.array([X[u == k].T @ e[u == k] for k in np.unique(u)])
    g = len(s)
    v = g / (g - 1) * 179 / 178 * inv @ s.T @ s @ inv
    r = one(R.cluster_se(frame(spark, y=y, x=x, u=u), "y", "x", "u"))
    assert r["se_slope"] == pytest.approx(np.sqrt(v[1, 1]), rel=1e-8)
    assert r["se_intercept"] == pytest.approx(np.sqrt(v[0, 0]), rel=1e-8)


def test_two_way_groups_of_unlike_scale(spark):
    """A group scaled by 1e9 beside a weakly linked chain panel of scale 1: each equals its own dummy regression."""
    rng = np.random.default_rng(12)
    rows = []
    for u in range(12):
        for t in range(15):
            if rng.random() < 0.6:
                x = rng.normal() + 0.3 * u
                rows.append(("a", f"u{u}", t, 1e9 * (2 * x + u + 0.1 * t + rng.normal()), x))
    for u in range(40):
        for t in (u, u + 1, u + 2):     # neighbours share two periods: a chain with as many cells as tell effects and slope apart
            x = rng.normal() + 0.05 * t
            rows.append(("b", f"u{u}", t, 2 * x + 0.2 * u - 0.1 * t + 0.1 * rng.normal(), x))
    for u in range(9):
        for t in (u, u + 1):            # neighbours share one period: a tree, whose effects explain any cell
            rows.append(("tree", f"u{u}", t, rng.normal(), rng.normal()))
    df = spark.createDataFrame(rows, "g string, u string, t int, y double, x double")
    got = {r["g"]: r for r in P.panel_ols(df, "y", "x", "t", "u", by=["g"]).collect()}
    for g in "ab":
        part = [r for r in rows if r[0] == g]
        units, times = sorted({r[1] for r in part}), sorted({r[2] for r in part})
        design = np.array([[r[4], *[float(r[1] == u) for u in units], *[float(r[2] == t) for t in times[1:]]] for r in part])
        want = np.linalg.lstsq(design, np.array([r[3] for r in part]), rcond=None)[0][0]
        assert got[g]["converged"] and got[g]["status"] == "ok" and abs(got[g]["estimate"] / want - 1) < 1e-7
    assert got["tree"]["status"] == "error" and "explain the predictor" in got["tree"]["error"] and got["tree"]["estimate"] is None

"""Forecast and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import forecast as FC
from ..operators import prepare as PP
from .base import (LINE, LINE_BY, MONTHLY, ORACLES, PANEL, SERIES, TREATED, X, Y, line_ctes, monthly, normal_quantile_sql, panel, query, shown, table,
                   treated_panel)
from .estimates import two_way_ctes

BY = ["o_orderpriority"]
H = "unnest(generate_series(1, 10))"


def _forecast_shown(df, *more, **digits):
    return shown(df, "o_orderpriority", "model", "h", "n_obs", *more, time=3, forecast=4, ci_lower=4, ci_upper=4, rmse=5, **digits)


def _forecast_select(model: str, point: str, band: str, source: str, more: str = "") -> str:
    return f"""SELECT g AS o_orderpriority, '{model}' AS model, CAST(h AS INTEGER) AS h, n AS n_obs, round(CAST(tl + h*step AS DOUBLE), 3) AS time,
  round({point}, 4) AS forecast, round({point} - {band}, 4) AS ci_lower, round({point} + {band}, 4) AS ci_upper, round(rmse, 5) AS rmse{more}
  FROM {source}, (SELECT {H} AS h)"""


FACTS = """k AS (SELECT g, any_value(n) AS n, max(t) AS tl, arg_max(y, t) AS yl, median(t - t1) AS step, sqrt(avg((y-y1)*(y-y1))) AS rw FROM s GROUP BY g)"""


@query("series_prepare", f"WITH {MONTHLY} SELECT o_orderpriority, m AS t, round(avg(o_totalprice), 4) AS y FROM monthly GROUP BY 1, 2")
def _(spark, d):
    s = FC.series_prepare(monthly(spark, d), "o_totalprice", "m", BY)
    return s.select("o_orderpriority", F.col("_t").cast("int").alias("t"), F.round("_y", 4).alias("y"))


@query("series_by_time", f"WITH {MONTHLY} SELECT m AS time, round(avg(o_totalprice), 4) AS y, count(*) AS n FROM monthly GROUP BY 1")
def _(spark, d):
    s = PP.series_by_time(monthly(spark, d), "o_totalprice", "m")
    return s.select(F.col("time").cast("int").alias("time"), F.round("y", 4).alias("y"), "n")


@query("forecast_random_walk", f"WITH {SERIES}, {FACTS}, z AS (SELECT *, rw AS rmse FROM k) "
       + _forecast_select("random_walk", "yl", "1.96*rmse*sqrt(h)", "z"))
def _(spark, d):
    return _forecast_shown(FC.forecast_random_walk(monthly(spark, d), "o_totalprice", "m", 10, BY))


AR = f"""{SERIES}, {FACTS}, {line_ctes("SELECT g, y, y1 AS x FROM s WHERE y1 IS NOT NULL")},
  z AS (SELECT k.*, a, b AS phi, sqrt(rss/fit.n) AS rmse, 4 + fit.n*ln(rss/fit.n) AS aic FROM k JOIN fit USING (g))"""


@query("forecast_ar1", f"WITH {AR} " + _forecast_select("ar1", "(a*(1-power(phi,h))/(1-phi) + power(phi,h)*yl)", "1.96*rmse*sqrt(h)", "z",
                                                        ", round(aic, 6) AS aic, round(phi, 8) AS ar1"))
def _(spark, d):
    return _forecast_shown(FC.forecast_ar1(monthly(spark, d), "o_totalprice", "m", 10, BY), aic=6, ar1=8)


@query("forecast_linear_trend", f"""WITH {SERIES}, {FACTS}, {line_ctes("SELECT g, y, t AS x FROM s")},
  z AS (SELECT k.*, a, b, my, mx, sqrt(rss/fit.n) AS rmse FROM k JOIN fit USING (g)) """
       + _forecast_select("linear_trend", "(my + b*(tl + h*step - mx))", "1.96*rmse*sqrt(1 + h/CAST(n AS DOUBLE))", "z"))
def _(spark, d):
    return _forecast_shown(FC.forecast_linear_trend(monthly(spark, d), "o_totalprice", "m", 10, BY))


@query("forecast_exp_smoothing", f"""WITH RECURSIVE {SERIES}, {FACTS}, al AS (SELECT round(0.05*i, 2)::DOUBLE AS alpha FROM range(1, 20) r(i)),
  w(g, alpha, i, level, sse) AS (SELECT g, alpha, i, y, 0.0::DOUBLE FROM s, al WHERE i = 1
    UNION ALL SELECT s.g, w.alpha, s.i, alpha*s.y + (1-alpha)*level, sse + (s.y-level)*(s.y-level) FROM w JOIN s ON s.g = w.g AND s.i = w.i + 1),
  e AS (SELECT w.g, alpha, level, sse FROM w JOIN k USING (g) WHERE i = n),
  z AS (SELECT k.*, alpha, level, sqrt(sse/(n-1)) AS rmse FROM k JOIN (
    SELECT g, arg_min(alpha, sse) AS alpha, arg_min(level, sse) AS level, min(sse) AS sse FROM e GROUP BY g) USING (g)) """
       + _forecast_select("exp_smoothing", "level", "1.96*rmse*sqrt(h)", "z", ", round(alpha, 2) AS alpha"))
def _(spark, d):
    return _forecast_shown(FC.forecast_exp_smoothing(monthly(spark, d), "o_totalprice", "m", 10, BY), alpha=2)


@query("forecast_arima")
def _(spark, d):
    return FC.forecast_arima(monthly(spark, d), "o_totalprice", "m", 10, BY)


@query("forecast_arima_per_user")
def _(spark, d):
    ev = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"), "value")
    return FC.forecast_arima(ev, "value", "day", 5, ["user_id"])


SMOOTHED = f"""al AS (SELECT round(0.05*i, 2)::DOUBLE AS alpha FROM range(1, 20) r(i)),
  sm(g, alpha, i, level, sse) AS (SELECT g, alpha, i, y, 0.0::DOUBLE FROM s, al WHERE i = 1
    UNION ALL SELECT s.g, sm.alpha, s.i, alpha*s.y + (1-alpha)*level, sse + (s.y-level)*(s.y-level) FROM sm JOIN s ON s.g = sm.g AND s.i = sm.i + 1),
  es AS (SELECT g, arg_min(level, sse) AS nx, sqrt(min(sse)/(any_value(n)-1)) AS rmse FROM sm JOIN k USING (g) WHERE i = n GROUP BY g)"""


@query("forecast_compare", f"""WITH RECURSIVE {AR}, {SMOOTHED},
  lt AS (SELECT g, my + b*(tl + step - mx) AS nx, sqrt(rss/nn) AS rmse FROM (SELECT k.g, tl, step, any_value(cnt) AS nn, any_value(my2) AS my, any_value(mx2) AS mx,
    sum((t-mx2)*(y-my2))/sum((t-mx2)*(t-mx2)) AS b, sum((y-my2)*(y-my2)) - power(sum((t-mx2)*(y-my2)), 2)/sum((t-mx2)*(t-mx2)) AS rss
    FROM s JOIN k USING (g) JOIN (SELECT g, avg(t) AS mx2, avg(y) AS my2, count(*) AS cnt FROM s GROUP BY g) USING (g) GROUP BY k.g, tl, step)),
  u AS (SELECT g, 'linear_trend' AS model, nx, rmse FROM lt UNION ALL SELECT g, 'exp_smoothing', nx, rmse FROM es UNION ALL SELECT g, 'random_walk', yl, rw FROM k)
SELECT u.g AS o_orderpriority, CAST(row_number() OVER (PARTITION BY u.g ORDER BY u.rmse) AS INTEGER) AS rank, model, round(u.rmse, 5) AS rmse,
  round(nx, 4) AS next_forecast, n AS n_obs, round(u.rmse/rw, 7) AS vs_random_walk FROM u JOIN k USING (g)""")
def _(spark, d):
    r = FC.forecast_compare(monthly(spark, d), "o_totalprice", "m", 10, BY, ["linear_trend", "exp_smoothing", "random_walk"])
    return shown(r, "o_orderpriority", "rank", "model", "n_obs", rmse=5, next_forecast=4, vs_random_walk=7)


@query("forecast_compare_all")
def _(spark, d):
    """All four models; the order grid of the fourth is not SQL, its rows are those of ``forecast_arima`` (tests)."""
    return FC.forecast_compare(monthly(spark, d), "o_totalprice", "m", 10, BY)


# --- diagnostics -------------------------------------------------------------------------------------------

def _check(df, *keys, **digits):
    return shown(df, *keys, "check_id", "status", **{"statistic": 6, **digits})


def _prepared(spark, d):
    return FC.series_prepare(monthly(spark, d), "o_totalprice", "m", BY)


@query("adf_lag0", f"""WITH {SERIES}, {line_ctes("SELECT g, y - y1 AS y, y1 AS x FROM s WHERE y1 IS NOT NULL")}
SELECT g AS o_orderpriority, 'adf' AS check_id, round(b/sqrt(rss/(n-2)/sxx), 6) AS statistic FROM fit""")
def _(spark, d):
    return shown(D.adf_test(_prepared(spark, d), BY, auto_lag=False), "o_orderpriority", "check_id", statistic=6)


def _eliminated(name: str, steps: str) -> str:
    """Table ``name`` of square matrices m after each of ``steps`` columns was swept out."""
    return f"""{name}_out AS (SELECT g, 0 AS k, m FROM {name} UNION ALL SELECT g, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j:
    v - r[k+1]*m[k+1][j]/m[k+1][k+1])) FROM {name}_out WHERE k < {steps})"""


def _grams(name: str, rows: str) -> str:
    """Matrices of products of the lists v in ``rows``, per g."""
    return f"""{name}_pairs AS (SELECT g, i, j, sum(v[i]*v[j]) AS p FROM (SELECT *, unnest(range(1, len(v)+1)) AS j FROM (SELECT g, v, unnest(range(1, len(v)+1)) AS i FROM {rows})) GROUP BY g, i, j),
  {name} AS (SELECT g, list(r ORDER BY i) AS m FROM (SELECT g, i, list(p ORDER BY j) AS r FROM {name}_pairs GROUP BY g, i) GROUP BY g)"""


ADF = f"""WITH RECURSIVE {SERIES}, c AS (SELECT g, i, n, y - avg(y) OVER (PARTITION BY g) AS y, y - y1 AS d, CAST(greatest(least(ceil(12*power(n/100.0, 0.25)), n//2 - 2), 0) AS BIGINT) AS most FROM s),
  l AS (SELECT g, list(y ORDER BY i) AS ys, list(d ORDER BY i) AS ds, any_value(n) AS n, any_value(most) AS most FROM c GROUP BY g),
  t AS (SELECT *, unnest(range(most+2, n+1)) AS t FROM l),
  wide AS (SELECT g, [1.0::DOUBLE, ys[t-1]] || list_transform(range(1, most+1), lambda j: ds[t-j]) || [ds[t]] AS v FROM t), {_grams("first", "wide")},
  {_eliminated("first", "len(m) - 1")},
  aic AS (SELECT g, k - 2 AS lag, (n-most-1)*(ln(2*pi()*m[len(m)][len(m)]/(n-most-1)) + 1) + 2*k AS aic FROM first_out JOIN l USING (g) WHERE k >= 2),
  chosen AS (SELECT g, arg_min(lag, aic) AS lag FROM aic GROUP BY g),
  t2 AS (SELECT *, unnest(range(lag+2, n+1)) AS t FROM l JOIN chosen USING (g)),
  own AS (SELECT g, [1.0::DOUBLE] || list_transform(range(1, lag+1), lambda j: ds[t-j]) || [ys[t-1], ds[t]] AS v FROM t2), {_grams("second", "own")},
  {_eliminated("second", "len(m) - 2")},
  z AS (SELECT g, lag, n - lag - 1 AS rows, m[lag+2][lag+2] AS a, m[lag+2][lag+3] AS b, m[lag+3][lag+3] AS c FROM second_out JOIN chosen USING (g) JOIN l USING (g) WHERE k = lag + 1)
SELECT g AS o_orderpriority, 'adf' AS check_id, round((b/a)/sqrt((c - b*b/a)/(rows-lag-2)/a), 6) AS statistic, CAST(lag AS DOUBLE) AS lag, CAST(rows AS DOUBLE) AS n_used,
  round(-2.86154 - 2.8903/rows - 4.234/power(rows, 2) - 40.040/power(rows, 3), 8) AS crit_5 FROM z"""


@query("adf_test", ADF)
def _(spark, d):
    r = D.adf_test(_prepared(spark, d), BY)
    r = r.withColumns({c: F.col("detail")[c] for c in ("lag", "n_used", "crit_5")})
    return shown(r, "o_orderpriority", "check_id", "lag", "n_used", statistic=6, crit_5=8)


KPSS = f"""{SERIES}, e AS (SELECT g, i, n, y - avg(y) OVER (PARTITION BY g) AS e FROM s),
  c AS (SELECT g, i, n, e, sum(e) OVER (PARTITION BY g ORDER BY i) AS cs FROM e)"""


@query("kpss_fixed_lag", f"""WITH {KPSS}, l AS (SELECT a.g, k, sum(a.e*b.e) AS p FROM e a JOIN (SELECT unnest(generate_series(1, 4)) AS k) ON TRUE
    JOIN e b ON b.g = a.g AND b.i = a.i - k GROUP BY a.g, k),
  v AS (SELECT g, sum(2*p*(1 - k/5.0)) AS extra FROM l GROUP BY g), t AS (SELECT g, any_value(n) AS n, sum(cs*cs) AS eta, sum(e*e) AS e2 FROM c GROUP BY g)
SELECT g AS o_orderpriority, 'kpss' AS check_id, round(eta/(CAST(n AS DOUBLE)*n)/((e2+extra)/n), 7) AS statistic FROM t JOIN v USING (g)""")
def _(spark, d):
    return shown(D.kpss_test(_prepared(spark, d), BY, lag=4), "o_orderpriority", "check_id", statistic=7)


@query("kpss_test", f"""WITH {KPSS}, ck AS (SELECT g, CAST(floor(power(n, 2.0/9)) AS INTEGER) AS cl FROM s GROUP BY g, n),
  a AS (SELECT x.g, x.i - z.i AS k, sum(x.e*z.e) AS p FROM e x JOIN e z ON x.g = z.g AND z.i < x.i GROUP BY 1, 2),
  b AS (SELECT g, any_value(n) AS n, sum(e*e) AS e2 FROM e GROUP BY g),
  h AS (SELECT b.g, any_value(b.n) AS n, any_value(e2) AS e2, any_value(e2)/any_value(b.n) + sum(p)/(any_value(b.n)/2.0) AS s0,
        sum(k*p)/(any_value(b.n)/2.0) AS s1 FROM b JOIN ck USING (g) JOIN a ON a.g = b.g AND a.k <= cl GROUP BY b.g),
  w AS (SELECT g, n, e2, least(floor(1.1447*power(power(s1/s0, 2), 1.0/3)*power(n, 1.0/3)), n-1) AS lag FROM h),
  v AS (SELECT w.g, sum(2*p*(1 - k/(lag+1))) AS extra FROM w JOIN a ON a.g = w.g AND a.k <= lag GROUP BY w.g),
  t AS (SELECT g, sum(cs*cs) AS eta FROM c GROUP BY g),
  o AS (SELECT g, lag, eta/(CAST(n AS DOUBLE)*n)/((e2 + coalesce(extra, 0))/n) AS st FROM w JOIN t USING (g) LEFT JOIN v USING (g)),
  p AS (SELECT *, CASE WHEN st < 0.347 THEN 0.1 WHEN st <= 0.463 THEN 0.1 + (st-0.347)/(0.463-0.347)*(0.05-0.1)
    WHEN st <= 0.574 THEN 0.05 + (st-0.463)/(0.574-0.463)*(0.025-0.05) WHEN st <= 0.739 THEN 0.025 + (st-0.574)/(0.739-0.574)*(0.01-0.025)
    ELSE 0.01 END AS p FROM o)
SELECT g AS o_orderpriority, 'kpss' AS check_id, CASE WHEN p < 0.05 THEN 'violated' ELSE 'ok' END AS status, round(st, 7) AS statistic,
  round(p, 7) AS pvalue, CAST(lag AS DOUBLE) AS lag FROM p""")
def _(spark, d):
    r = D.kpss_test(_prepared(spark, d), BY)
    return shown(r.withColumn("lag", F.col("detail")["lag"]), "o_orderpriority", "check_id", "status", "lag", statistic=7, pvalue=7)


@query("ljung_box", f"""WITH {SERIES}, e AS (SELECT g, i, n, y - avg(y) OVER (PARTITION BY g) AS e FROM s),
  a AS (SELECT x.g, any_value(x.n) AS n, x.i - z.i AS k, sum(x.e*z.e) AS p FROM e x JOIN e z ON x.g = z.g AND x.i - z.i BETWEEN 0 AND 10 GROUP BY x.g, x.i - z.i),
  z AS (SELECT g, p AS g0 FROM a WHERE k = 0)
SELECT g AS o_orderpriority, 'ljung_box' AS check_id, round(any_value(n)*(any_value(n)+2)*sum(power(p/g0, 2)/(n-k)), 7) AS statistic
FROM a JOIN z USING (g) WHERE k > 0 GROUP BY g""")
def _(spark, d):
    return shown(D.ljung_box(_prepared(spark, d), "_t", BY, value="_y"), "o_orderpriority", "check_id", statistic=7)


@query("durbin_watson", f"""WITH {PANEL}, {line_ctes("SELECT 0 AS g, y, x FROM panel")},
  e AS (SELECT u, t, (y-my)-b*(x-mx) AS e FROM panel, fit), l AS (SELECT e, e - lag(e) OVER (PARTITION BY u ORDER BY t) AS de FROM e)
SELECT 'durbin_watson' AS check_id, CASE WHEN abs(sum(de*de)/sum(e*e) - 2) > 0.5 THEN 'violated' ELSE 'ok' END AS status,
  round(sum(de*de)/sum(e*e), 8) AS statistic FROM l""")
def _(spark, d):
    r = D.ols_residuals(panel(spark, d), "y", "x", (), ["u", "t"])
    return _check(D.durbin_watson(r, "t", ["u"]), statistic=8)


@query("breusch_pagan", f"""WITH {line_ctes(LINE_BY)}, e AS (SELECT g, n, power((y-my)-b*(x-mx), 2) AS e2, my+b*(x-mx) AS ft FROM f JOIN fit USING (g))
SELECT g AS l_returnflag, 'breusch_pagan' AS check_id, round(any_value(n)*power(corr(e2, ft), 2), 6) AS statistic FROM e GROUP BY g""")
def _(spark, d):
    r = D.ols_residuals(table(spark, d, "lineitem"), Y, X, ["l_returnflag"])
    return shown(D.breusch_pagan(r, ["l_returnflag"]), "l_returnflag", "check_id", statistic=6)


@query("jarque_bera", f"""WITH {line_ctes("SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem")},
  e AS (SELECT g, (l_extendedprice-my)-b*(l_quantity-mx) AS e FROM lineitem JOIN fit ON g = l_returnflag), c AS (SELECT g, avg(e) AS m FROM e GROUP BY g),
  k AS (SELECT g, count(*) AS n, avg(power(e-m, 2)) AS m2, avg(power(e-m, 3)) AS m3, avg(power(e-m, 4)) AS m4 FROM e JOIN c USING (g) GROUP BY g)
SELECT g AS l_returnflag, 'jarque_bera' AS check_id, CASE WHEN exp(-j/2) < 0.05 THEN 'violated' ELSE 'ok' END AS status, round(j, 4) AS statistic FROM (
  SELECT g, n/6.0*(power(m3/power(m2, 1.5), 2) + power(m4/(m2*m2) - 3, 2)/4) AS j FROM k)""")
def _(spark, d):
    r = D.ols_residuals(table(spark, d, "lineitem"), Y, X, ["l_returnflag"])
    return shown(D.jarque_bera(r, ["l_returnflag"]), "l_returnflag", "check_id", "status", statistic=4)


@query("shapiro_wilk", f"""WITH {line_ctes(LINE_BY)}, e AS (SELECT g, n, (y-my)-b*(x-mx) AS e, row_number() OVER (PARTITION BY g ORDER BY (y-my)-b*(x-mx)) AS i FROM f JOIN fit USING (g)),
  z AS (SELECT g, n, i, e, {normal_quantile_sql("(i - 0.375)/(n + 0.25)")} AS m FROM e),
  k AS (SELECT g, any_value(n) AS n, sum(power(e - mean, 2)) AS ss, sum(m*m) AS total, sum(m*e) AS dot, max(CASE WHEN i = n THEN m END) AS ml, max(CASE WHEN i = n-1 THEN m END) AS mb,
        max(e) - min(e) AS wide, max(CASE WHEN i = n-1 THEN e END) - max(CASE WHEN i = 2 THEN e END) AS inside FROM z JOIN (SELECT g, avg(e) AS mean FROM e GROUP BY g) USING (g) GROUP BY g),
  u AS (SELECT *, 1/sqrt(n) AS u FROM k),
  a AS (SELECT *, ((((-2.706056*u + 4.434685)*u - 2.071190)*u - 0.147981)*u + 0.221157)*u + ml/sqrt(total) AS a1,
        ((((-3.582633*u + 5.682633)*u - 1.752461)*u - 0.293762)*u + 0.042981)*u + mb/sqrt(total) AS a2 FROM u)
SELECT g AS l_returnflag, 'shapiro_wilk' AS check_id, round(power(a1*wide + a2*inside + (dot - ml*wide - mb*inside)/sqrt((total - 2*ml*ml - 2*mb*mb)/(1 - 2*a1*a1 - 2*a2*a2)), 2)/ss, 9) AS statistic,
  CAST(n AS DOUBLE) AS n_used FROM a""")
def _(spark, d):
    r = D.ols_residuals(table(spark, d, "lineitem"), Y, X, ["l_returnflag"])
    r = D.shapiro_wilk(r, ["l_returnflag"])
    return shown(r.withColumn("n_used", F.col("detail")["n_used"]), "l_returnflag", "check_id", "n_used", statistic=9)


@query("vif", """WITH r AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT c AS "column", n AS n_obs, round(1/(1-r*r), 9) AS vif, 1/(1-r*r) > 10 AS violated FROM r, (VALUES ('l_quantity'), ('l_extendedprice')) v(c)""")
def _(spark, d):
    return shown(D.vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "column", "n_obs", "violated", vif=9)


@query("parallel_trends", f"""WITH {TREATED}, k AS (SELECT *, max(d) OVER (PARTITION BY u) > 0 AS tr FROM treated),
  p AS (SELECT * FROM k WHERE t < (SELECT min(t) FROM treated WHERE d > 0)), m AS (SELECT tr, avg(t) AS mt, avg(y) AS my FROM p GROUP BY tr),
  a AS (SELECT tr, count(*) AS n, sum((t-mt)*(t-mt)) AS stt, sum((t-mt)*(y-my)) AS sty, sum((y-my)*(y-my)) AS syy FROM p JOIN m USING (tr) GROUP BY tr),
  r AS (SELECT sum(n) AS n, sum(syy - sty*sty/stt) AS rss, max(CASE WHEN tr THEN sty/stt END) - max(CASE WHEN NOT tr THEN sty/stt END) AS dif, sum(1/stt) AS iv FROM a)
SELECT 'parallel_trends' AS check_id, round(dif, 5) AS statistic, round(sqrt(rss/(n-4)*iv), 5) AS interaction_se, CAST(n AS DOUBLE) AS n_pre,
  {14}.0::DOUBLE AS first_treatment_period FROM r""")
def _(spark, d):
    r = D.parallel_trends(treated_panel(spark, d), "y", "d", "t", "u")
    r = r.select("check_id", "statistic", *[F.col("detail")[k].alias(k) for k in ("interaction_se", "n_pre", "first_treatment_period")])
    return shown(r, "check_id", "n_pre", "first_treatment_period", statistic=5, interaction_se=5)


def _jarque_bera_sql(rows: str) -> str:
    """Table of g and j from the residuals e in ``rows``."""
    return f"""(SELECT g, n/6.0*(power(m3/power(m2, 1.5), 2) + power(m4/(m2*m2) - 3, 2)/4) AS j FROM (SELECT g, count(*) AS n, avg(power(e-m, 2)) AS m2, avg(power(e-m, 3)) AS m3, avg(power(e-m, 4)) AS m4
    FROM {rows} JOIN (SELECT g, avg(e) AS m FROM {rows} GROUP BY g) USING (g) GROUP BY g))"""


AR_RESIDUALS = f"""{SERIES}, {line_ctes("SELECT g, y, y1 AS x FROM s WHERE y1 IS NOT NULL")},
  res AS (SELECT s.g, i, (y-my)-b*(y1-mx) AS e FROM s JOIN fit ON fit.g = s.g WHERE y1 IS NOT NULL)"""


@query("arima_diagnostics", f"""SELECT o_orderpriority, 'arima' AS suite, check_id, round(statistic, 5) AS statistic FROM (
  SELECT o_orderpriority, check_id, statistic FROM ({ADF}) UNION ALL SELECT o_orderpriority, check_id, statistic FROM ({ORACLES["kpss_test"]})
  UNION ALL SELECT * FROM (WITH {AR_RESIDUALS}, e AS (SELECT g, i, e - avg(e) OVER (PARTITION BY g) AS e, count(*) OVER (PARTITION BY g) AS n FROM res),
    a AS (SELECT x.g, any_value(x.n) AS n, x.i - z.i AS k, sum(x.e*z.e) AS p FROM e x JOIN e z ON x.g = z.g AND x.i - z.i BETWEEN 0 AND 10 GROUP BY x.g, x.i - z.i),
    z AS (SELECT g, p AS g0 FROM a WHERE k = 0) SELECT g, 'ljung_box', any_value(n)*(any_value(n)+2)*sum(power(p/g0, 2)/(n-k)) FROM a JOIN z USING (g) WHERE k > 0 GROUP BY g)
  UNION ALL SELECT * FROM (WITH {AR_RESIDUALS} SELECT g, 'jarque_bera', j FROM {_jarque_bera_sql("res")}))""")
def _(spark, d):
    """No level fails the unit root test in these series, so their differences are not tested (tests have such a series).

    The first two statistics are those that ``adf_test`` and ``kpss_test`` show: rounded there, then here.
    """
    r = D.arima_diagnostics(monthly(spark, d), "o_totalprice", "m", BY)
    own = F.when(F.col("check_id") == "adf", F.round("statistic", 6)).when(F.col("check_id") == "kpss", F.round("statistic", 7))
    return shown(r.withColumn("statistic", F.coalesce(own, F.col("statistic"))), "o_orderpriority", "suite", "check_id", statistic=5)


@query("did_diagnostics", f"""SELECT 'did' AS suite, check_id, round(statistic, 5) AS statistic FROM (SELECT check_id, statistic FROM ({ORACLES["parallel_trends"]})
  UNION ALL SELECT * FROM (WITH {TREATED}, {two_way_ctes("treated", "d")}, res AS (SELECT 0 AS g, u, t, dy - b*dx AS e, y - (dy - b*dx) AS ft FROM z JOIN c USING (u, t), b),
    l AS (SELECT e, e - lag(e) OVER (PARTITION BY u ORDER BY t) AS de FROM res)
    SELECT 'breusch_pagan', count(*)*power(corr(e*e, ft), 2) FROM res UNION ALL SELECT 'durbin_watson', sum(de*de)/sum(e*e) FROM l UNION ALL SELECT 'jarque_bera', j FROM {_jarque_bera_sql("res")}))""")
def _(spark, d):
    return shown(D.did_diagnostics(treated_panel(spark, d), "y", "d", "t", "u"), "suite", "check_id", statistic=5)


@query("ols_diagnostics", f"""WITH {line_ctes(LINE_BY)}, e AS (SELECT g, n, (y-my)-b*(x-mx) AS e, my+b*(x-mx) AS ft FROM f JOIN fit USING (g)),
  c AS (SELECT g, avg(e) AS m FROM e GROUP BY g), k AS (SELECT g, count(*) AS n, avg(power(e-m, 2)) AS m2, avg(power(e-m, 3)) AS m3, avg(power(e-m, 4)) AS m4 FROM e JOIN c USING (g) GROUP BY g)
SELECT g AS l_returnflag, 'ols' AS suite, 'breusch_pagan' AS check_id, round(any_value(n)*power(corr(e*e, ft), 2), 4) AS statistic FROM e GROUP BY g
UNION ALL SELECT g, 'ols', 'jarque_bera', round(n/6.0*(power(m3/power(m2, 1.5), 2) + power(m4/(m2*m2) - 3, 2)/4), 4) FROM k""")
def _(spark, d):
    r = D.ols_diagnostics(table(spark, d, "lineitem"), Y, X, ["l_returnflag"])
    return shown(r, "l_returnflag", "suite", "check_id", statistic=4)


@query("corrective_switch", f"""WITH {PANEL}, {line_ctes("SELECT u AS g, y, x FROM panel")},
  e AS (SELECT u, t, (y-my)-b*(x-mx) AS e FROM panel JOIN fit ON g = u), l AS (SELECT u, e, e - lag(e) OVER (PARTITION BY u ORDER BY t) AS de FROM e),
  w AS (SELECT u, abs(sum(de*de)/sum(e*e) - 2) > 0.5 AS bad FROM l GROUP BY u)
SELECT u, 'panel_ols' AS model, CASE WHEN bad THEN 'first_difference' ELSE 'panel_ols' END AS final_model,
  CASE WHEN bad THEN 'durbin_watson' END AS because FROM w""")
def _(spark, d):
    p = panel(spark, d)
    r = D.ols_residuals(p, "y", "x", ["u"], ["t"])
    checks = D.durbin_watson(r, "t", [], ["u"])
    spec = PP.PanelSpec("y", "x", "u", "t")
    ok = PP.admissible_models(p.withColumn("nation", F.col("u")), PP.PanelSpec("y", "x", "nation", "t", spec.question_type), ["u"])
    return D.corrective_switch(checks, p.select("u").distinct().withColumn("model", F.lit("panel_ols")), ok, ["u"])

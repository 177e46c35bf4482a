"""Post-estimation, text and table queries.

The text queries run on one result row per supplier: an entity-effects fit with the three return flags as
units. Its t distribution has two degrees of freedom, for which SQL has the p-value in closed form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diagnostics as D
from ..operators import forecast as FC
from ..operators import post as PO
from ..operators import regress as R
from ..operators import tables as TB
from .base import (LINE_BY, MONTHLY, PANEL, SERIES, X, Y, line_ctes, long_panel, monthly, normal_quantile_sql, panel, query, rounded, shown, table)
from .estimates import median_ctes
from .forecasts import AR

KEY = ["l_suppkey"]
CRIT2 = 4.302652729911275           # 97.5 % point of t with two degrees of freedom

RESULTS = f"""i AS (SELECT l_suppkey AS k, l_returnflag AS u, l_extendedprice AS y, l_quantity AS x FROM lineitem),
  im AS (SELECT k, u, avg(y) AS my, avg(x) AS mx FROM i GROUP BY 1, 2),
  iz AS (SELECT k, u, y-my AS dy, x-mx AS dx FROM i JOIN im USING (k, u)),
  ib AS (SELECT k, count(*) AS n, count(DISTINCT u) AS g, sum(dx*dy)/sum(dx*dx) AS b, sum(dx*dx) AS sxx, sum(dy*dy) AS syy FROM iz GROUP BY k),
  isc AS (SELECT k, u, sum(dx*(dy-b*dx)) AS s, sum(power(dy-b*dx, 2)) AS rss FROM iz JOIN ib USING (k) GROUP BY k, u),
  iv AS (SELECT k, sqrt(sum(s*s)) AS root, sum(rss) AS rss FROM isc GROUP BY k),
  res AS (SELECT k AS l_suppkey, n, b, sqrt(CAST(g AS DOUBLE)/(g-1))*root/sxx AS se, 1-rss/syy AS r2 FROM ib JOIN iv USING (k)),
  results AS (SELECT *, b/se AS t, 1 - abs(b/se)/sqrt(2+power(b/se, 2)) AS p, b - {CRIT2}*se AS lo, b + {CRIT2}*se AS hi FROM res)"""


def results(spark, d):
    return R.entity_fe(table(spark, d, "lineitem"), Y, X, "l_returnflag", KEY)


@query("result_inference", f"""WITH {RESULTS} SELECT l_suppkey, n AS n_obs, round(b, 5) AS estimate, round(se, 5) AS se, round(t, 6) AS t_stat, round(p, 8) AS pvalue,
  round(lo, 4) AS ci_lower, round(hi, 4) AS ci_upper, p < 0.05 AS significant FROM results""")
def _(spark, d):
    return shown(results(spark, d), "l_suppkey", "n_obs", "significant", estimate=5, se=5, t_stat=6, pvalue=8, ci_lower=4, ci_upper=4)


# --- scenarios ----------------------------------------------------------------------------------------

@query("whatif_regression", f"""WITH {line_ctes(LINE_BY)}, z AS (SELECT l_returnflag, l_partkey, max(l_quantity) AS x FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_partkey, x, 'ols' AS model, round(a+b*x, 4) AS predicted, round(a+b*x - 1.96*se*abs(x-mx), 4) AS pred_lower,
  round(a+b*x + 1.96*se*abs(x-mx), 4) AS pred_upper, round(b*(x-mx), 5) AS delta_vs_baseline FROM z JOIN fit ON g = l_returnflag""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    scenarios = li.groupBy("l_returnflag", "l_partkey").agg(F.max("l_quantity").alias("x"))
    r = PO.whatif_regression(R.ols(li, Y, X, ["l_returnflag"]), scenarios, ["l_returnflag"])
    return rounded(r, predicted=4, pred_lower=4, pred_upper=4, delta_vs_baseline=5)


@query("whatif_shock", f"""WITH {AR}, sh AS (SELECT o_orderpriority AS g, stddev_samp(o_totalprice) AS shock FROM orders GROUP BY 1)
SELECT g AS o_orderpriority, 'ar1' AS model, round(shock, 3) AS shock, CAST(h AS INTEGER) AS h, round(CAST(tl + h*step AS DOUBLE), 3) AS time,
  round(a*(1-power(phi,h))/(1-phi) + power(phi,h)*yl + shock*power(phi, h-1), 3) AS forecast, round(yl + shock, 3) AS shocked_last
FROM z JOIN sh USING (g), (SELECT unnest(generate_series(1, 10)) AS h)""")
def _(spark, d):
    m = monthly(spark, d)
    shocks = m.groupBy("o_orderpriority").agg(F.stddev_samp("o_totalprice").alias("shock"))
    r = PO.whatif_shock(FC.forecast_ar1(m, "o_totalprice", "m", 10, ["o_orderpriority"]), shocks, ["o_orderpriority"])
    return rounded(r, shock=3, time=3, forecast=3, shocked_last=3)


@query("whatif_dispatch", f"""WITH {line_ctes(LINE_BY)} SELECT g AS l_returnflag, 40.0::DOUBLE AS x, 'ols' AS model, round(a+b*40, 4) AS predicted, round(a+b*40 - 1.96*se*abs(40-mx), 4) AS pred_lower,
  round(a+b*40 + 1.96*se*abs(40-mx), 4) AS pred_upper, round(b*(40-mx), 5) AS delta_vs_baseline FROM fit""")
def _(spark, d):
    r = PO.whatif(R.ols(table(spark, d, "lineitem"), Y, X, ["l_returnflag"]), {"x": 40})
    return rounded(r, predicted=4, pred_lower=4, pred_upper=4, delta_vs_baseline=5)


@query("whatif_slider", f"""WITH {line_ctes(LINE_BY)}, h AS (SELECT *, greatest(abs(mx)*0.5, 10.0) AS w FROM fit),
  s AS (SELECT *, CAST(step AS INTEGER) AS st, mx - w + 2*w*step/200 AS x FROM h, (SELECT unnest(generate_series(0, 200)) AS step))
SELECT g AS l_returnflag, st AS step, round(x, 6) AS x, 'ols' AS model, round(a+b*x, 4) AS predicted, round(a+b*x - 1.96*se*abs(x-mx), 4) AS pred_lower,
  round(a+b*x + 1.96*se*abs(x-mx), 4) AS pred_upper, round(b*(x-mx), 5) AS delta_vs_baseline FROM s""")
def _(spark, d):
    r = PO.whatif_slider(R.ols(table(spark, d, "lineitem"), Y, X, ["l_returnflag"]), ["l_returnflag"])
    return rounded(r, x=6, predicted=4, pred_lower=4, pred_upper=4, delta_vs_baseline=5)


# --- eras, robustness, groups ----------------------------------------------------------------------------

EVENTS = ((20.0, "Dot-com bust"), (45.0, "Accession year"))


def _era_ctes(edges: str) -> str:
    return f"""o AS (SELECT CAST((year(o_orderdate)-1995)*12+month(o_orderdate) AS INTEGER) AS t, o_totalprice AS yy,
    CASE WHEN o_orderpriority='1-URGENT' THEN 1.0 ELSE 0.0 END AS xx FROM orders JOIN customer ON o_custkey=c_custkey),
  er(era, lo, hi, last, label) AS (VALUES {edges}), {line_ctes("SELECT era AS g, yy AS y, xx AS x FROM o JOIN er ON t >= lo AND (t < hi OR (last AND t <= hi)) UNION ALL SELECT 0, yy, xx FROM o")},
  main AS (SELECT b AS mb FROM fit WHERE g = 0)"""


ERAS = _era_ctes("(1, 1, 20, false, 'first span'), (2, 20, 45, false, 'Dot-com bust'), (3, 45, 80, true, 'Accession year')")


@query("era_effects", f"""WITH {ERAS} SELECT CAST(era AS INTEGER) AS era, label, lo || '–' || hi AS period, round(b, 4) AS estimate, round(se, 4) AS se, n AS n_obs,
  CASE WHEN (b >= 0) = (mb >= 0) THEN '✓ consistent' ELSE '✗ sign flip' END AS consistent FROM fit JOIN er ON era = g, main""")
def _(spark, d):
    r = PO.era_effects(long_panel(spark, d), "ols", "y", "x", "t", events=EVENTS)
    return shown(r, "era", "label", "period", "n_obs", "consistent", estimate=4, se=4)


@query("structural_break", f"""WITH {ERAS} SELECT count(*) AS n_eras, round(max(abs(b))/min(abs(b)), 6) AS effect_ratio, max(abs(b))/min(abs(b)) > 2.5 AS structural_break,
  min(sign(b)) <> max(sign(b)) AS sign_reversal FROM fit JOIN er ON era = g""")
def _(spark, d):
    return rounded(PO.structural_break(PO.era_effects(long_panel(spark, d), "ols", "y", "x", "t", events=EVENTS)), effect_ratio=6)


@query("robustness_table", f"""WITH RECURSIVE {PANEL}, ls(g, y, x) AS (SELECT 'ols', y, x FROM panel UNION ALL SELECT 'pooled_ols', y, x FROM panel
    UNION ALL SELECT 'log_linear', ln(y), x FROM panel WHERE y > 0 UNION ALL SELECT 'log_log', ln(y), ln(x) FROM panel WHERE y > 0 AND x > 0
    UNION ALL SELECT 'first_difference', y - y1, x - x1 FROM (SELECT y, x, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM panel WINDOW w AS (PARTITION BY u ORDER BY t)) WHERE x1 IS NOT NULL
    UNION ALL SELECT 'entity_fe', y - avg(y) OVER (PARTITION BY u), x - avg(x) OVER (PARTITION BY u) FROM panel
    UNION ALL SELECT 'time_fe', y - avg(y) OVER (PARTITION BY t), x - avg(x) OVER (PARTITION BY t) FROM panel
    UNION ALL SELECT 'panel_ols', y - avg(y) OVER (PARTITION BY u) - avg(y) OVER (PARTITION BY t) + avg(y) OVER (), x - avg(x) OVER (PARTITION BY u) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () FROM panel),
  {line_ctes("SELECT g, y, x FROM ls")}, {median_ctes("SELECT 'median_quantile' AS g, y, x FROM panel", "md")},
  pc AS (SELECT y - avg(y) OVER () AS dy, x - avg(x) OVER () AS d FROM panel), pv AS (SELECT avg(d*d) AS vx FROM pc),
  pz AS (SELECT dy, d, d*d - vx AS q FROM pc, pv),
  pk AS (SELECT count(*) AS n, (sum(q*q)*sum(d*dy) - sum(d*q)*sum(q*dy))/(sum(d*d)*sum(q*q) - power(sum(d*q), 2)) AS b FROM pz),
  every AS (SELECT g, b, n FROM fit UNION ALL SELECT 'median_quantile', b, n FROM md_b JOIN md_m USING (g) UNION ALL SELECT 'polynomial_ols', b, n FROM pk),
  o AS (SELECT b AS mb FROM fit WHERE g = 'entity_fe')
SELECT g AS model, 'ok' AS status, round(b, 4) AS estimate, n AS n_obs, CASE WHEN (b >= 0) = (mb >= 0) THEN '✓' ELSE '✗ sign flip' END AS consistent FROM every, o""")
def _(spark, d):
    models = ["ols", "pooled_ols", "log_linear", "log_log", "polynomial_ols", "median_quantile", "first_difference", "time_fe", "panel_ols"]
    r = PO.robustness_table(panel(spark, d), "entity_fe", models, "y", "x", "t", "u")
    return shown(r, "model", "status", "n_obs", "consistent", estimate=4)


@query("split_by", f"WITH {line_ctes(LINE_BY)} SELECT g AS \"group\", 'ok' AS status, n, round(b, 6) AS estimate, round(se, 6) AS se FROM fit")
def _(spark, d):
    return shown(PO.split_by(table(spark, d, "lineitem"), "ols", Y, X, "l_returnflag"), "group", "status", "n", estimate=6, se=6)


PREDICTORS = ["l_quantity", "l_discount", "l_tax"]


@query("compare_predictors", "WITH " + line_ctes(" UNION ALL ".join(f"SELECT '{p}' AS g, l_extendedprice AS y, {p} AS x FROM lineitem" for p in PREDICTORS))
       + """ SELECT g AS predictor, 'ok' AS status, n AS n_obs, round(b, 5) AS estimate, round(se, 5) AS se, round(r2, 9) AS r_squared,
  CASE WHEN r2 >= max(r2) OVER () - 0.001 THEN '★' ELSE '' END AS stronger FROM fit""")
def _(spark, d):
    r = PO.compare_predictors(table(spark, d, "lineitem"), Y, PREDICTORS)
    return shown(r, "predictor", "status", "n_obs", "stronger", estimate=5, se=5, r_squared=9)


@query("confidence_score", f"""WITH {RESULTS}, {line_ctes("SELECT l_suppkey AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem")},
  rd AS (SELECT g, l_linenumber AS ln, l_orderkey AS ok, (l_extendedprice-my)-b*(l_quantity-mx) AS e FROM lineitem JOIN fit ON g = l_suppkey),
  dl AS (SELECT g, e, e - lag(e) OVER (PARTITION BY g ORDER BY ok, ln, e) AS de FROM rd),
  dw AS (SELECT g, abs(sum(de*de)/sum(e*e) - 2) <= 0.5 AS good FROM dl GROUP BY g),
  c AS (SELECT l_suppkey, greatest(0, 40*(1-8*least(1, p))) AS sig, CASE WHEN good THEN 25.0 ELSE 0.0 END AS diag, 20*least(1, ln(n)/ln(1000.0)) AS samp FROM results JOIN dw ON g = l_suppkey)
SELECT l_suppkey, CAST(round_even(sig+diag+samp+7.5, 0) AS INTEGER) AS score, CAST(round_even(sig, 0) AS INTEGER) AS sig, CAST(round_even(diag, 0) AS INTEGER) AS diag,
  CAST(round_even(samp, 0) AS INTEGER) AS samp, 8 AS era,
  CASE WHEN round_even(sig+diag+samp+7.5, 0) >= 70 THEN 'High confidence' WHEN round_even(sig+diag+samp+7.5, 0) >= 45 THEN 'Moderate confidence' ELSE 'Low confidence' END AS label FROM c""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    resid = D.ols_residuals(li, Y, X, KEY, ["l_orderkey", "l_linenumber"])
    checks = D.durbin_watson(resid, ["l_orderkey", "l_linenumber", "_e"], [], KEY)
    return PO.confidence_score(results(spark, d), checks, None, KEY).drop("model")


def _curve(steps: int, half: str) -> str:
    return f"""WITH {line_ctes(LINE_BY)}, a AS (SELECT l_returnflag AS g, min(l_quantity) AS lo, max(l_quantity) AS hi, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1),
  c AS (SELECT *, lo + (hi-lo)*step/{steps} AS x FROM (SELECT unnest(generate_series(0, {steps})) AS step), fit JOIN a USING (g)),
  v AS (SELECT *, my + b*(x-mx) AS l, {half} AS w FROM c)
SELECT g AS l_returnflag, CAST(step AS INTEGER) AS step, round(x, 6) AS x, round(l, 4) AS fit, round(l-w, 4) AS lower, round(l+w, 4) AS upper FROM v"""


@query("marginal_curve", _curve(40, "1.96*se*sqrt(1/sqrt(n) + abs(x-mx)/sd)"))
def _(spark, d):
    li = table(spark, d, "lineitem")
    r = PO.marginal_curve(li, R.ols(li, Y, X, ["l_returnflag"]), Y, X, ["l_returnflag"])
    return rounded(r, x=6, fit=4, lower=4, upper=4)


@query("fit_line", _curve(20, "1.96*se*abs(x-mx)/(sd+0.001)"))
def _(spark, d):
    li = table(spark, d, "lineitem")
    r = PO.fit_line(li, R.ols(li, Y, X, ["l_returnflag"]), Y, X, ["l_returnflag"])
    return rounded(r, x=6, fit=4, lower=4, upper=4)


RESID = f"""{line_ctes(LINE_BY)}, e AS (SELECT g, my+b*(x-mx) AS ft, y-my-b*(x-mx) AS e FROM f JOIN fit USING (g))"""


@query("residual_frame", f"""WITH {RESID}, a AS (SELECT g, count(*) AS n, stddev_pop(e) AS sd, min(ft) AS f0, max(ft) AS f1, covar_pop(ft, abs(e)) AS cv, min(abs(e)) AS a0, max(abs(e)) AS a1 FROM e GROUP BY g)
SELECT g AS l_returnflag, n AS n_obs, round(sd, 4) AS resid_sd, round(f0, 4) AS fit_min, round(f1, 4) AS fit_max, round(cv, 3) AS cov_abs_fit,
  abs(cv) > 0.3*(a1-a0)*(f1-f0)/n AS possible_heteroscedasticity FROM a""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    r = PO.residual_frame(li, R.ols(li, Y, X, ["l_returnflag"]), Y, X, ["l_returnflag"])
    return rounded(r, resid_sd=4, fit_min=4, fit_max=4, cov_abs_fit=3)


@query("qq_points", f"""WITH {RESID}, rk AS (SELECT g, e, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY e) AS i FROM e),
  kk AS (SELECT g, avg(e) AS m, stddev_samp(e) AS sd, any_value(n) AS n FROM rk GROUP BY g), qp AS (SELECT *, unnest(range(100)) AS point FROM kk)
SELECT qp.g AS l_returnflag, CAST(point AS INTEGER) AS point, round({normal_quantile_sql("(point + 0.5)/100")}, 9) AS theoretical, round((e - m)/sd, 7) AS sample
FROM qp JOIN rk ON rk.g = qp.g AND rk.i = greatest(ceil((point + 0.5)/100*qp.n), 1)""")
def _(spark, d):
    """Order statistics at ceil(p n); the sketch holds groups of up to its accuracy exactly."""
    li = table(spark, d, "lineitem")
    return rounded(PO.qq_points(li, R.ols(li, Y, X, ["l_returnflag"]), Y, X, 100, ["l_returnflag"]), theoretical=9, sample=7)


# --- over time --------------------------------------------------------------------------------------------

@query("trend_summary", f"""WITH {SERIES}, b AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
  e AS (SELECT g, avg(CASE WHEN i <= n//4 THEN y END) AS early, avg(CASE WHEN i > n - n//4 THEN y END) AS late FROM s GROUP BY g)
SELECT g AS o_orderpriority, n, round(mean, 4) AS mean, round(std, 4) AS std, lo AS min, hi AS max, round(early, 4) AS early, round(late, 4) AS late,
  round((late-early)*100/early, 6) AS pct_change, CASE WHEN late > early THEN 'rose' WHEN late < early THEN 'fell' ELSE 'stayed flat' END AS direction,
  CASE WHEN std/abs(mean) < 0.1 THEN 'low' WHEN std/abs(mean) < 0.4 THEN 'moderate' ELSE 'high' END AS volatility FROM b JOIN e USING (g)""")
def _(spark, d):
    r = PO.trend_summary(monthly(spark, d), "o_totalprice", "m", ["o_orderpriority"])
    return rounded(r, mean=4, std=4, early=4, late=4, pct_change=6)


@query("historical_summary", f"""WITH {MONTHLY} SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min,
  max(o_totalprice) AS max, count(*) AS n, CAST(min(m) AS BIGINT) AS first_time, CAST(max(m) AS BIGINT) AS last_time FROM monthly GROUP BY 1""")
def _(spark, d):
    return rounded(PO.historical_summary(monthly(spark, d), "o_totalprice", "m", ["o_orderpriority"]), mean=4, std=4)


@query("time_range", "SELECT CAST(min(year(l_shipdate)) AS BIGINT) AS first_time, CAST(max(year(l_shipdate)) AS BIGINT) AS last_time FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("yr", F.year("l_shipdate"))
    return PO.historical_summary(li, Y, "yr").select("first_time", "last_time")


@query("event_notes", f"""WITH {MONTHLY}, ev AS (SELECT DISTINCT m AS event_time, 'month with an order above 499000' AS event FROM monthly WHERE o_totalprice > 499000),
  w AS (SELECT event_time, event, avg(o_totalprice) AS wm, count(*) AS n FROM ev JOIN monthly ON m BETWEEN event_time AND event_time + 2 GROUP BY 1, 2), a AS (SELECT avg(o_totalprice) AS om FROM monthly)
SELECT event_time, event, round(wm, 4) AS window_mean, CAST(n AS BIGINT) AS window_rows, round(om, 4) AS overall_mean, round(abs(wm-om)/(abs(om)+0.001)*100, 6) AS pct_deviation,
  CASE WHEN wm > om THEN 'above' ELSE 'below' END AS direction FROM w, a""")
def _(spark, d):
    m = monthly(spark, d)
    events = m.where(F.col("o_totalprice") > 499000).select(F.col("m").alias("event_time"), F.lit("month with an order above 499000").alias("event")).distinct()
    return rounded(PO.event_notes(m, "o_totalprice", "m", events), window_mean=4, overall_mean=4, pct_deviation=6)


# --- outliers and insights ----------------------------------------------------------------------------------

@query("outlier_rows", f"""WITH {PANEL}, {line_ctes("SELECT 0 AS g, y, x FROM panel")}, e AS (SELECT u, t, y-my-b*(x-mx) AS e FROM panel, fit), s AS (SELECT stddev_pop(e) AS sd FROM e)
SELECT u, t, round(e, 3) AS residual, round(e/sd, 7) AS z FROM e, s WHERE abs(e) > 2*sd""")
def _(spark, d):
    p = panel(spark, d)
    return rounded(PO.outlier_rows(p, R.ols(p, "y", "x"), "y", "x", ["u", "t"]), residual=3, z=7)


@query("outlier_units", """WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS um FROM lineitem GROUP BY 1), c AS (SELECT avg(um) AS a, stddev_samp(um) AS s FROM m)
SELECT l_suppkey, round(um, 4) AS unit_mean, round((um-a)/s, 7) AS z FROM m, c WHERE abs(um-a) > 1.5*s""")
def _(spark, d):
    return rounded(PO.outlier_units(table(spark, d, "lineitem"), Y, "l_suppkey"), unit_mean=4, z=7)


@query("stronger_signal", """WITH c AS (SELECT corr(l_extendedprice*l_quantity, l_extendedprice) AS a, corr(l_extendedprice*l_quantity, l_tax) AS b, count(*) AS n FROM lineitem)
SELECT 'l_extendedprice' AS "column", round(a, 9) AS r, n FROM c WHERE abs(a) > 0.4 AND abs(a) > abs(b)""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("value", F.col(Y) * F.col(X))
    return rounded(PO.stronger_signal(li, "value", X, [Y, "l_tax"]), r=9)


@query("nonlinearity_hint", """WITH f AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem), m AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx FROM f GROUP BY g),
  k AS (SELECT g, any_value(n) AS n, sum(d*d) AS sdd, sum(d*q) AS sdq, sum(q*q) AS sqq, sum(d*dy) AS sdy, sum(q*dy) AS sqy, sum(dy*dy) AS syy FROM (
    SELECT g, n, x-mx AS d, (x-mx)*(x-mx)-vx AS q, y-my AS dy FROM f JOIN m USING (g)) GROUP BY g),
  r AS (SELECT g, n, sdy*sdy/(sdd*syy) AS r1, (sqq*sdy*sdy - 2*sdq*sdy*sqy + sdd*sqy*sqy)/(sdd*sqq-sdq*sdq)/syy AS r2 FROM k)
SELECT g AS l_returnflag, n AS n_obs, round(r1, 9) AS r2_linear, round(r2, 9) AS r2_quadratic, n >= 15 AND r2 - r1 > 0.05 AND r2 > 0.02 AS nonlinear FROM r""")
def _(spark, d):
    return rounded(PO.nonlinearity_hint(table(spark, d, "lineitem"), Y, X, ["l_returnflag"]), r2_linear=9, r2_quadratic=9)


@query("scale_mismatch", f"""WITH {line_ctes("SELECT l_returnflag AS g, l_discount AS y, l_extendedprice AS x FROM lineitem")}
SELECT g AS l_returnflag, round(mx, 4) AS x_mean, round(my, 8) AS y_mean, round(abs(mx)/abs(my), 2) AS scale_ratio, abs(mx)/abs(my) > 1000 AND abs(b) < 1e-3 AS mismatch FROM fit""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    r = PO.scale_mismatch(li, R.ols(li, "l_discount", Y, ["l_returnflag"]), "l_discount", Y, ["l_returnflag"])
    return rounded(r, x_mean=4, y_mean=8, scale_ratio=2)


@query("mixed_frequency", """WITH t AS (SELECT DISTINCT o_orderpriority, o_orderdate AS d FROM orders), g AS (SELECT o_orderpriority, date_diff('day', lag(d) OVER (PARTITION BY o_orderpriority ORDER BY d), d) AS gap FROM t),
  n AS (SELECT o_orderpriority, count(*) AS n, regr_r2(o_totalprice, o_custkey) AS r2 FROM orders GROUP BY 1), k AS (SELECT o_orderpriority, count(*) AS k, median(gap) AS mg FROM g GROUP BY 1)
SELECT o_orderpriority, n AS n_stamps, k AS n_distinct, CAST(mg AS DOUBLE) AS median_gap_days, true AS has_macro_column, n > 50 AND mg <= 5 AND r2 < 0.01 AS mixed FROM n JOIN k USING (o_orderpriority)""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("growth", F.col("o_custkey"))
    by = ["o_orderpriority"]
    return PO.mixed_frequency(o, R.ols(o, "o_totalprice", "growth", by), "o_orderdate", by)


@query("no_signal", f"""WITH {RESULTS} SELECT l_suppkey, 'entity_fe' AS model, round(r2, 9) AS r_squared, round(p, 8) AS pvalue, n AS n_obs, r2 < 0.005 AND p > 0.4 AND n > 200 AS no_signal FROM results""")
def _(spark, d):
    return rounded(PO.no_signal(results(spark, d), KEY), r_squared=9, pvalue=8)


@query("low_variation", """SELECT p_type, count(*) AS n, round(stddev_samp(p_retailprice)/abs(avg(p_retailprice)), 9) AS cv,
  stddev_samp(p_retailprice)/abs(avg(p_retailprice)) BETWEEN 1e-300 AND 0.05 AND count(*) > 5 AS low_variation FROM part GROUP BY 1""")
def _(spark, d):
    return rounded(PO.low_variation(table(spark, d, "part"), "p_retailprice", ["p_type"]), cv=9)


@query("insights")
def _(spark, d):
    p = panel(spark, d)
    return PO.insights(p, R.ols(p, "y", "x"), "y", "x", "t", "u")


# --- tables and texts -------------------------------------------------------------------------------------

STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '†' ELSE '' END"


@query("regression_table", f"""WITH {RESULTS} SELECT l_suppkey, CAST(row AS INTEGER) AS row, label, CASE row WHEN 1 THEN printf('%+.4f', b) || {STARS} WHEN 2 THEN '(' || printf('%.4f', se) || ')'
  WHEN 3 THEN printf('%.4f', r2) WHEN 4 THEN format('{{:,}}', n) WHEN 5 THEN 'Entity fixed effects' ELSE 'clustered (unit level)' END AS entity_fe
FROM results, (VALUES (1, 'coefficient'), (2, 'standard error'), (3, 'R²'), (4, 'N'), (5, 'Fixed Effects'), (6, 'SE type')) v(row, label)""")
def _(spark, d):
    return TB.regression_table(results(spark, d), ["entity_fe"], KEY)


@query("table_lines")
def _(spark, d):
    p = panel(spark, d)
    both = R.ols(p, "y", "x").unionByName(R.entity_fe(p, "y", "x", "u"))
    t = TB.regression_table(both, ["ols", "entity_fe"])
    return TB.table_lines(t, ["ols", "entity_fe"], "x", "y")


@query("stars", f"WITH {RESULTS} SELECT l_suppkey, {STARS} AS stars FROM results")
def _(spark, d):
    return results(spark, d).select("l_suppkey", T.stars(F.col("pvalue")).alias("stars"))


def _words(words, text="low") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


TEXTS = "t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"


def _texts(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    conv = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    return docs.unionByName(conv)


def _classes(future, cause) -> str:
    return f"CASE WHEN {_words(future)} THEN 'forecast' WHEN {_words(cause)} THEN 'causal_effect' ELSE 'association' END"


@query("classify_question", f"WITH {TEXTS}, l AS (SELECT id, lower(text) AS low FROM t) SELECT id, {_classes(T.FORECAST_WORDS, T.CAUSAL_WORDS)} AS question_type, {_words(T.LAG_WORDS)} AS asks_for_lag FROM l")
def _(spark, d):
    return _texts(spark, d).select("id", T.classify_question(F.col("text")).alias("question_type"), T.asks_for_lag(F.col("text")).alias("asks_for_lag"))


COLUMNS = ["country", "the", "year", "und", "que", "rate"]
NUMERIC = ["year", "rate", "und"]


@query("match_columns", f"""WITH {TEXTS}, l AS (SELECT id, lower(text) AS low FROM t),
  n AS (SELECT id, low, list_filter([{', '.join(f"CASE WHEN contains(low, '{c}') THEN '{c}' END" for c in COLUMNS)}], lambda c: c IS NOT NULL) AS named FROM l),
  o AS (SELECT *, coalesce(named[1], 'rate') AS outcome FROM n)
SELECT id, outcome, coalesce(named[2], CASE WHEN {_classes(T.FORECAST_WORDS_WEB, T.CAUSAL_WORDS_WEB)} <> 'forecast' THEN list_filter(['year', 'rate', 'und'], lambda c: c <> outcome)[1] END) AS treatment FROM o""")
def _(spark, d):
    m = _texts(spark, d).select("id", T.match_columns(F.col("text"), COLUMNS, NUMERIC).alias("m"))
    return m.select("id", "m.outcome", "m.treatment")


def _case(rows) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{value}'" for cond, value in rows) + " END"


@query("infer_domain", f"WITH {TEXTS}, l AS (SELECT id, lower(text) AS low FROM t) SELECT id, {_case([(_words(w), n) for n, w in T.DOMAINS])} AS domain FROM l")
def _(spark, d):
    return _texts(spark, d).select("id", T.infer_domain(F.col("text"), F.lit(None).cast("string")).alias("domain"))


def _law_hit(ys, xs) -> str:
    return f"CASE WHEN {_words(ys, 'o')} THEN {_words(xs, 'tr')} ELSE {_words(ys, 'tr')} AND {_words(xs, 'o')} END"


@query("known_law", f"""WITH l AS (SELECT doc_id, lower(text) AS o, lower(coalesce(string_agg(b.text, ' '), '')) AS tr FROM documents LEFT JOIN (SELECT item_id, text FROM benchmark) b ON b.item_id = doc_id % (SELECT max(item_id) + 1 FROM benchmark) GROUP BY doc_id, documents.text)
SELECT doc_id, {_case([(_law_hit(ys, xs), n.replace(chr(39), chr(39) * 2)) for n, ys, xs, _ in T.LAWS])} AS law FROM l""".replace("lower(text) AS o", "lower(documents.text) AS o"))
def _(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("other"))
    items = b.agg(F.max("k")).first()[0] + 1        # every item meets documents
    docs = table(spark, d, "documents").withColumn("k", F.col("doc_id") % items).join(b, "k", "left")
    return docs.select("doc_id", T.known_law(F.col("text"), F.col("other"))["law"].alias("law"))


@query("r2_context", f"""WITH {RESULTS}, x AS (SELECT l_suppkey, r2, printf('%.1f', r2*100) || '% of the variance is explained' AS head FROM results)
SELECT l_suppkey, head || '; finance usually has 2 to 15%, so this is ' || CASE WHEN r2 < 0.02 THEN 'below' WHEN r2 > 0.15 THEN 'above' ELSE 'inside' END || ' its range' AS for_finance,
  head || ': ' || CASE WHEN r2 < 0.05 THEN 'next to nothing' WHEN r2 < 0.2 THEN 'little' WHEN r2 < 0.5 THEN 'a good part' ELSE 'most of it' END AS general FROM x""")
def _(spark, d):
    return results(spark, d).select("l_suppkey", T.r2_context(F.col("r_squared"), F.lit("finance")).alias("for_finance"),
                                    T.r2_context(F.col("r_squared"), F.lit("")).alias("general"))


@query("sanity_notes", f"""WITH {RESULTS}, m AS (SELECT l_suppkey, avg(l_extendedprice) AS ym FROM lineitem GROUP BY 1),
  a AS (SELECT l_suppkey, list_filter([
    CASE WHEN abs(b)/abs(ym) > 1 THEN 'size: ' || printf('%.6g', b) || ' against a mean of ' || printf('%.4g', ym) || ' for l_extendedprice; look at the units, and at which causes which'
      WHEN abs(b)/abs(ym) < 0.001 THEN 'size: ' || printf('%.6g', b) || ' against a mean of ' || printf('%.4g', ym) || ' for l_extendedprice, under a thousandth of it' END,
    CASE WHEN n < 30 THEN 'rows: only ' || n || ', so the interval is wide' END,
    CASE WHEN lo <= 0 AND hi >= 0 THEN 'interval: it holds zero, so the sign is open' END,
    CASE WHEN p > 0.1 THEN 'p-value: ' || printf('%.3f', p) || ' leaves the sign a guess' END,
    CASE WHEN r2 < 0.05 THEN 'fit: R² ' || printf('%.3f', r2) || ', most of l_extendedprice has other sources' END],
    lambda c: c IS NOT NULL) AS notes FROM results JOIN m USING (l_suppkey))
SELECT l_suppkey, 'entity_fe' AS model, array_to_string(CASE WHEN len(notes) > 0 THEN notes ELSE ['nothing stands out; whatever moves both l_quantity and l_extendedprice would still bias this'] END, chr(10)) AS notes,
  CAST(greatest(len(notes), 1) AS INTEGER) AS n_notes FROM a""")
def _(spark, d):
    return TB.sanity(results(spark, d), table(spark, d, "lineitem"), Y, KEY)


@query("verdict", f"""WITH {RESULTS}, h AS (SELECT *, 'l_extendedprice' || CASE WHEN b > 0 THEN ' rises by ' ELSE ' falls by ' END || printf('%.3g', abs(b)) || ' per unit of l_quantity' AS head FROM results)
SELECT l_suppkey, CASE WHEN p < 0.05 AND (lo > 0 OR hi < 0) THEN head || '; zero lies outside the interval' WHEN p < 0.05 THEN head || '; p = ' || printf('%.3f', p)
  ELSE 'how l_quantity moves l_extendedprice is not settled: ' || printf('%+.3g', b) || ' per unit, p = ' || printf('%.3f', p) END AS verdict FROM h""")
def _(spark, d):
    return TB.result_texts(results(spark, d), KEY).select("l_suppkey", "verdict")


@query("plain_english", f"""WITH {RESULTS}, h AS (SELECT *, CAST(least(99, floor(p*100)) AS INTEGER) AS ch FROM results)
SELECT l_suppkey, 'One unit more goes with ' || printf('%.3g', abs(b)) || CASE WHEN b > 0 THEN ' more.' ELSE ' less.' END || chr(10)
  || 'Without any relation, ' || ch || ' of 100 samples would show as much; we ' || CASE WHEN p < 0.05 THEN 'take it as real.' ELSE 'leave it open.' END
  || CASE WHEN lo < 0 AND hi > 0 THEN ' Either sign is possible.' ELSE '' END || chr(10)
  || 'Of 100 parts of the outcome''s variation it covers ' || printf('%.1f', r2*100) || CASE WHEN r2 < 0.1 THEN ', a small part.' WHEN r2 < 0.3 THEN ', a part.' ELSE ', a large part.' END AS plain_english FROM h""")
def _(spark, d):
    return TB.result_texts(results(spark, d), KEY).select("l_suppkey", "plain_english")


@query("regression_summary", f"""WITH {RESULTS} SELECT l_suppkey, 'Entity fixed effects: ' || CASE WHEN b > 0 THEN 'positive' WHEN b < 0 THEN 'negative' ELSE 'no' END
  || ' relation, ' || format('{{:,.4f}}', b) || ' of l_extendedprice per unit of l_quantity' || chr(10) || 'p = ' || printf('%.4f', p) || CASE WHEN p < 0.05 THEN ', under 0.05' ELSE ', not under 0.05' END
  || '; 95% from ' || format('{{:,.4f}}', lo) || ' to ' || format('{{:,.4f}}', hi) || CASE WHEN lo <= 0 AND hi >= 0 THEN ', zero inside' ELSE ', zero outside' END
  || chr(10) || 'R² ' || printf('%.4f', r2) || ' over ' || n || ' rows' AS summary FROM results""")
def _(spark, d):
    return TB.result_texts(results(spark, d), KEY).select("l_suppkey", "summary")


@query("effect_strength", f"""WITH {RESULTS}, w AS (SELECT *, abs(hi-lo)/4 + 0.001 AS k FROM results)
SELECT l_suppkey, CASE WHEN b = 0 THEN 'none' WHEN abs(b) < 0.2*k THEN 'small' WHEN abs(b) < 0.8*k THEN 'medium' ELSE 'large' END AS strength FROM w""")
def _(spark, d):
    return TB.result_texts(results(spark, d), KEY).select("l_suppkey", "strength")


@query("forecast_summary", f"""WITH {AR}, p AS (SELECT g, yl, rmse, h, a*(1-power(phi,h))/(1-phi) + power(phi,h)*yl AS fc FROM z, (SELECT unnest(generate_series(1, 10)) AS h)),
  fs AS (SELECT g, any_value(yl) AS yl, any_value(rmse) AS rmse, max(CASE WHEN h = 1 THEN fc END) AS nx, avg(fc) AS av FROM p GROUP BY g)
SELECT g AS o_orderpriority, CASE WHEN nx > yl THEN 'up' WHEN nx < yl THEN 'down' ELSE 'level' END AS direction, round((nx-yl)*100/yl, 6) AS pct_change, round(nx, 4) AS next_value,
  round(av, 4) AS mean_forecast, CAST(10 AS BIGINT) AS periods,
  'next ' || format('{{:,.4f}}', nx) || ' after ' || format('{{:,.4f}}', yl) || ': ' || CASE WHEN nx > yl THEN 'up' WHEN nx < yl THEN 'down' ELSE 'level' END || ', ' || printf('%+.2f', (nx-yl)*100/yl) || '%'
  || chr(10) || 'mean of 10 steps ' || format('{{:,.4f}}', av) || chr(10) || 'one-step error ' || format('{{:,.4f}}', rmse) AS summary FROM fs""")
def _(spark, d):
    by = ["o_orderpriority"]
    r = TB.forecast_summary(FC.forecast_ar1(monthly(spark, d), "o_totalprice", "m", 10, by), by)
    return shown(r, "o_orderpriority", "direction", "periods", "summary", pct_change=6, next_value=4, mean_forecast=4)


@query("diagnostics_summary", f"""WITH {line_ctes("SELECT l_suppkey AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem")},
  rd AS (SELECT g, l_linenumber AS ln, l_orderkey AS ok, (l_extendedprice-my)-b*(l_quantity-mx) AS e FROM lineitem JOIN fit ON g = l_suppkey),
  dl AS (SELECT g, e, e - lag(e) OVER (PARTITION BY g ORDER BY ok, ln, e) AS de FROM rd), dw AS (SELECT g, sum(de*de)/sum(e*e) AS dw FROM dl GROUP BY g)
SELECT g AS l_suppkey, CASE WHEN abs(dw-2) > 0.5 THEN 'failed: DW ' || printf('%.3f', dw) || ' is more than 0.5 away from 2: neighbours in time are related' || chr(10) || chr(10) || 'failed checks:' || chr(10)
    || '- Durbin-Watson' || chr(10) || chr(10) || 'what to do:' || chr(10) || '- model the time order, or use errors that allow for it'
  ELSE 'passed: DW ' || printf('%.3f', dw) || ' is within 0.5 of 2' || chr(10) || chr(10) || 'no check failed' END AS summary FROM dw""")
def _(spark, d):
    resid = D.ols_residuals(table(spark, d, "lineitem"), Y, X, KEY, ["l_orderkey", "l_linenumber"])
    checks = D.durbin_watson(resid, ["l_orderkey", "l_linenumber", "_e"], [], KEY)
    return TB.diagnostics_summary(checks, KEY).select("l_suppkey", "summary")


@query("followups", f"""WITH {RESULTS} SELECT l_suppkey, array_to_string(['another model for l_extendedprice', 'a part of the rows', 'l_quantity changed by a tenth', 'one more predictor'], chr(10)) AS followups FROM results""")
def _(spark, d):
    return results(spark, d).select("l_suppkey", F.array_join(T.followups(F.col("model"), F.col("outcome"), F.col("treatment")), "\n").alias("followups"))

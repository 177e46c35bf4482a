"""Regression, panel and standard-error queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import median as M
from ..operators import panel as P
from ..operators import regress as R
from .base import (LINE, LINE_BY, PANEL, TREATED, X, Y, line_ctes, line_select, line_shown, long_panel, panel, query, shown,
                   table, treated_panel)


def lines(spark, d):
    return table(spark, d, "lineitem")


@query("ols", line_select(LINE, "ols"))
def _(spark, d):
    return line_shown(R.ols(lines(spark, d), Y, X))


@query("ols_by_group", line_select(LINE_BY, "ols", key="l_returnflag"))
def _(spark, d):
    return line_shown(R.ols(lines(spark, d), Y, X, ["l_returnflag"]), "l_returnflag")


@query("pooled_ols", line_select("SELECT 0 AS g, y, x FROM panel", "pooled_ols", (4, 3, 4), ctes=PANEL + ", "))
def _(spark, d):
    return line_shown(R.pooled_ols(panel(spark, d), "y", "x"), digits=(4, 3, 4))


@query("log_linear", line_select(
    "SELECT 0 AS g, ln(l_extendedprice) AS y, l_quantity AS x FROM lineitem WHERE l_extendedprice > 0", "log_linear", (10, 8, 10),
    extra=", round(100*(exp(b)-1), 8) AS semi_elasticity"))
def _(spark, d):
    r = R.log_linear(lines(spark, d), Y, X)
    r = r.withColumn("semi_elasticity", F.round(F.col("extra")["semi_elasticity_percent"], 8))
    return line_shown(r, digits=(10, 8, 10), extra=("semi_elasticity",))


@query("log_log", line_select(
    "SELECT 0 AS g, ln(l_extendedprice) AS y, ln(l_quantity) AS x FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0",
    "log_log", (10, 8, 10)))
def _(spark, d):
    return line_shown(R.log_log(lines(spark, d), Y, X), digits=(10, 8, 10))


POLY = f"""{line_ctes(LINE)},
  v AS (SELECT avg((x-mx)*(x-mx)) AS vx FROM f JOIN m USING (g)),
  z AS (SELECT x-mx AS d, (x-mx)*(x-mx)-vx AS q, y-my AS dy, mx, my, vx FROM f JOIN m USING (g), v),
  k AS (SELECT count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(vx) AS vx, sum(d*d) AS sdd, sum(d*q) AS sdq,
        sum(q*q) AS sqq, sum(d*dy) AS sdy, sum(q*dy) AS sqy, sum(dy*dy) AS syy FROM z),
  c AS (SELECT *, sdd*sqq-sdq*sdq AS det, (sqq*sdy-sdq*sqy)/(sdd*sqq-sdq*sdq) AS b1, (sdd*sqy-sdq*sdy)/(sdd*sqq-sdq*sdq) AS b2 FROM k),
  w AS (SELECT sum(power((sqq*d-sdq*q)/det*(dy-b1*d-b2*q), 2)) AS meat, sum(power(dy-b1*d-b2*q, 2)) AS rss
        FROM (SELECT z.d, z.q, z.dy, c.sqq, c.sdq, c.det, c.b1, c.b2 FROM z, c))"""


@query("polynomial_ols", f"""WITH {POLY} SELECT 'polynomial_ols' AS model, n AS n_obs, round(b1, 6) AS estimate,
  round(sqrt(CAST(n AS DOUBLE)/(n-3)*meat), 6) AS se, round(1-rss/syy, 9) AS r_squared, round(b1-2*b2*mx, 5) AS linear_term,
  round(b2, 7) AS quadratic_term FROM c, w""")
def _(spark, d):
    r = R.polynomial_ols(lines(spark, d), Y, X)
    r = r.select("model", "n_obs", "estimate", "se", "r_squared", F.col("extra")["linear_term"].alias("linear_term"),
                 F.col("extra")["quadratic_term"].alias("quadratic_term"))
    return shown(r, "model", "n_obs", estimate=6, se=6, r_squared=9, linear_term=5, quadratic_term=7)


def median_ctes(f_sql: str, name: str = "f") -> str:
    """The median slope b per ``g`` (table ``name``_b) by thirds: the least sum of |y - b x - median| is convex in b."""
    return f"""{name} AS MATERIALIZED ({f_sql}),
  {name}_m AS (SELECT g, count(*) AS n, avg(y) AS my, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b0, sqrt(regr_syy(y, x)/regr_sxx(y, x)) AS wide, median(y) AS ymed FROM {name} GROUP BY g),
  {name}_cut AS (SELECT g, 0 AS k, b0 - wide AS lo, b0 + wide AS hi FROM {name}_m
    UNION ALL SELECT g, k + 1, CASE WHEN l1 <= l2 THEN lo ELSE lo + (hi-lo)/3 END, CASE WHEN l1 <= l2 THEN hi - (hi-lo)/3 ELSE hi END FROM (
      SELECT g, k, lo, hi, sum(abs(r1-m1)) AS l1, sum(abs(r2-m2)) AS l2 FROM (
        SELECT g, k, lo, hi, r1, r2, median(r1) OVER (PARTITION BY g) AS m1, median(r2) OVER (PARTITION BY g) AS m2 FROM (
          SELECT c.g, k, lo, hi, y - (lo+(hi-lo)/3)*x AS r1, y - (hi-(hi-lo)/3)*x AS r2 FROM {name} JOIN {name}_cut c ON {name}.g = c.g WHERE k < 70))
      GROUP BY g, k, lo, hi)),
  {name}_b AS (SELECT g, (lo+hi)/2 AS b FROM {name}_cut WHERE k = 70)"""


def median_line_sql(f_sql: str, key: str | None = None) -> str:
    """The whole result row of the median line per ``g``; ``f_sql`` has g, y and x."""
    head = f"g AS {key}, " if key else ""
    return f"""WITH RECURSIVE {median_ctes(f_sql)},
  e AS (SELECT f.g, y - b*x AS r, abs(y - ymed) AS away FROM f JOIN f_b ON f.g = f_b.g JOIN f_m ON f.g = f_m.g),
  s AS (SELECT g, median(r) AS a, sum(away) AS abs0 FROM e GROUP BY g),
  o AS (SELECT e.g, median(abs(r - a)) AS mad, sum(abs(r - a)) AS loss FROM e JOIN s ON e.g = s.g GROUP BY e.g)
SELECT {head}'median_quantile' AS model, 'ok' AS status, n AS n_obs, round(b, 4) AS estimate, round(a, 2) AS intercept,
  round(1.4826*mad/sqrt(sxx), 4) AS se, round(1 - loss/abs0, 8) AS r_squared, true AS converged FROM f_m JOIN f_b USING (g) JOIN s USING (g) JOIN o USING (g)"""


def median_shown(df, *keys):
    return shown(df, *keys, "model", "status", "n_obs", "converged", estimate=4, intercept=2, se=4, r_squared=8)


@query("median_quantile", median_line_sql(LINE))
def _(spark, d):
    return median_shown(M.median_quantile(lines(spark, d), Y, X))


@query("median_quantile_by_group", median_line_sql(LINE_BY, "l_returnflag"))
def _(spark, d):
    return median_shown(M.median_quantile(lines(spark, d), Y, X, ["l_returnflag"]), "l_returnflag")


@query("median_quantile_panel", f"""WITH {PANEL},
  p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY u, t) AS i, y, x FROM panel),
  l AS MATERIALIZED (SELECT p.i, q.i AS j, (q.y-p.y)/(q.x-p.x) AS b, p.y - (q.y-p.y)/(q.x-p.x)*p.x AS a FROM p JOIN p q ON p.i < q.i AND p.x <> q.x),
  best AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(abs(y-a-b*x)) AS loss FROM l, p GROUP BY l.i, l.j ORDER BY loss LIMIT 1)
SELECT 'median_quantile' AS model, (SELECT count(*) FROM p) AS n_obs, round(a, 3) AS intercept, round(b, 4) AS estimate, round(loss, 3) AS loss FROM best""")
def _(spark, d):
    """The best of all lines through two cells."""
    r = M.median_quantile(panel(spark, d), "y", "x")
    return shown(r.withColumn("loss", F.col("extra")["loss"]), "model", "n_obs", intercept=3, estimate=4, loss=3)


def _absorbed(f_sql: str, unit: str) -> str:
    return f"""f AS ({f_sql}), m AS (SELECT {unit}, avg(y) AS my, avg(x) AS mx FROM f GROUP BY 1),
  z AS (SELECT f.{unit} AS k, f.x-m.mx AS dx, f.y-m.my AS dy FROM f JOIN m USING ({unit})),
  b AS (SELECT count(*) AS n, count(DISTINCT k) AS g, sum(dx*dy)/sum(dx*dx) AS b, sum(dx*dx) AS sxx, sum(dy*dy) AS syy FROM z)"""


@query("entity_fe", f"""WITH {_absorbed('SELECT l_suppkey AS u, l_extendedprice AS y, l_quantity AS x FROM lineitem', 'u')},
  s AS (SELECT k, sum(dx*(dy-b*dx)) AS s FROM z, b GROUP BY k), v AS (SELECT sum(s*s) AS meat FROM s),
  r AS (SELECT sum((dy-b*dx)*(dy-b*dx)) AS rss FROM z, b)
SELECT 'entity_fe' AS model, n AS n_obs, g AS n_units, round(b, 6) AS estimate, round(sqrt(CAST(g AS DOUBLE)/(g-1)*meat)/sxx, 6) AS se,
  round(1-rss/syy, 9) AS r_squared FROM b, v, r""")
def _(spark, d):
    return shown(R.entity_fe(lines(spark, d), Y, X, "l_suppkey"), "model", "n_obs", "n_units", estimate=6, se=6, r_squared=9)


@query("time_fe", f"""WITH {_absorbed('SELECT year(l_shipdate) AS u, l_extendedprice AS y, l_quantity AS x FROM lineitem', 'u')},
  r AS (SELECT sum(dx*dx*power(dy-b*dx, 2)) AS meat, sum(power(dy-b*dx, 2)) AS rss FROM z, b)
SELECT 'time_fe' AS model, n AS n_obs, g AS n_periods, round(b, 6) AS estimate, round(sqrt(CAST(n AS DOUBLE)/(n-1)*meat)/sxx, 6) AS se,
  round(1-rss/syy, 9) AS r_squared FROM b, r""")
def _(spark, d):
    df = lines(spark, d).withColumn("yr", F.year("l_shipdate"))
    return shown(R.time_fe(df, Y, X, "yr"), "model", "n_obs", "n_periods", estimate=6, se=6, r_squared=9)


DIFF = "SELECT 0 AS g, y - y1 AS y, x - x1 AS x FROM (SELECT y, x, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM panel WINDOW w AS (PARTITION BY u ORDER BY t)) WHERE x1 IS NOT NULL"


@query("first_difference", line_select(DIFF, "first_difference", (4, 4, 4), ctes=PANEL + ", ",
                                       extra=", (SELECT count(*) FROM (SELECT u FROM panel GROUP BY u HAVING count(*) > 1)) AS n_units"))
def _(spark, d):
    return line_shown(R.first_difference(panel(spark, d), "y", "x", "t", "u"), digits=(4, 4, 4), extra=("n_units",))


@query("first_difference_frame", f"""WITH {PANEL} SELECT u, t, round(y - y1, 4) AS dy, round(x - x1, 9) AS dx FROM (
  SELECT u, t, y, x, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM panel WINDOW w AS (PARTITION BY u ORDER BY t)) WHERE x1 IS NOT NULL""")
def _(spark, d):
    r = R.difference_rows(panel(spark, d), "y", "x", "t", "u")
    return r.select("u", F.col("_time").cast("int").alias("t"), F.round("_y", 4).alias("dy"), F.round("_x", 9).alias("dx"))


def two_way_ctes(source: str, x: str) -> str:
    """Two-way fixed effects by the closed form of a balanced panel."""
    return f"""c AS (SELECT u, t, y, {x} AS x FROM {source}),
  z AS (SELECT u, t, y - avg(y) OVER (PARTITION BY u) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS dy,
        x - avg(x) OVER (PARTITION BY u) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS dx FROM c),
  b AS (SELECT count(*) AS n, count(DISTINCT u) AS g, count(DISTINCT t) AS p, sum(dx*dy)/sum(dx*dx) AS b, sum(dx*dx) AS sxx, sum(dy*dy) AS syy FROM z),
  s AS (SELECT u, sum(dx*(dy-b*dx)) AS s FROM z, b GROUP BY u), v AS (SELECT sum(s*s) AS meat FROM s),
  r AS (SELECT sum(power(dy-b*dx, 2)) AS rss FROM z, b)"""


def _two_way_select(model: str) -> str:
    return f"""SELECT '{model}' AS model, n AS n_obs, g AS n_units, p AS n_periods, round(b, 4) AS estimate,
  round(sqrt(CAST(g AS DOUBLE)/(g-1)*meat)/sxx, 4) AS se, round(1-rss/syy, 9) AS r_squared FROM b, v, r"""


@query("panel_ols", f"WITH {PANEL}, {two_way_ctes('panel', 'x')} {_two_way_select('panel_ols')}")
def _(spark, d):
    return shown(P.panel_ols(panel(spark, d), "y", "x", "t", "u"), "model", "n_obs", "n_units", "n_periods", estimate=4, se=4, r_squared=9)


@query("diff_in_diff", f"WITH {TREATED}, {two_way_ctes('treated', 'd')} {_two_way_select('diff_in_diff')}")
def _(spark, d):
    return shown(P.diff_in_diff(treated_panel(spark, d), "y", "d", "t", "u"), "model", "n_obs", "n_units", "n_periods",
                 estimate=4, se=4, r_squared=9)


def _sweeps(count: int) -> str:
    """Two-way effects of an unbalanced panel with repeated rows, by alternating means spelled out."""
    ctes = ["""o AS (SELECT c.c_nationkey AS u, CAST((year(o_orderdate)-1995)*12+month(o_orderdate) AS INTEGER) AS t, o_totalprice AS y,
  CASE WHEN o_orderpriority='1-URGENT' THEN 1.0 ELSE 0.0 END AS x FROM orders JOIN customer c ON o_custkey=c.c_custkey),
  c AS MATERIALIZED (SELECT u, t, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM o GROUP BY 1, 2),
  g0 AS MATERIALIZED (SELECT DISTINCT t, 0.0::DOUBLE AS gx, 0.0::DOUBLE AS gy FROM c)"""]
    for i in range(count):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT u, sum(sx-n*gx)/sum(n) AS ax, sum(sy-n*gy)/sum(n) AS ay FROM c JOIN g{i} USING (t) GROUP BY u),
  g{i + 1} AS MATERIALIZED (SELECT t, sum(sx-n*ax)/sum(n) AS gx, sum(sy-n*ay)/sum(n) AS gy FROM c JOIN a{i} USING (u) GROUP BY t)""")
    ctes.append(f"""a{count} AS MATERIALIZED (SELECT u, sum(sx-n*gx)/sum(n) AS ax, sum(sy-n*gy)/sum(n) AS ay FROM c JOIN g{count} USING (t) GROUP BY u),
  z AS (SELECT u, t, x-ax-gx AS dx, y-ay-gy AS dy FROM o JOIN a{count} USING (u) JOIN g{count} USING (t))""")
    return ", ".join(ctes)


@query("panel_ols_unbalanced", f"""WITH {_sweeps(15)},
  b AS (SELECT count(*) AS n, count(DISTINCT u) AS g, count(DISTINCT t) AS p, sum(dx*dy)/sum(dx*dx) AS b, sum(dx*dx) AS sxx, sum(dy*dy) AS syy FROM z),
  s AS (SELECT u, sum(dx*(dy-b*dx)) AS s FROM z, b GROUP BY u), v AS (SELECT sum(s*s) AS meat FROM s),
  r AS (SELECT sum(power(dy-b*dx, 2)) AS rss FROM z, b) {_two_way_select('panel_ols')}""")
def _(spark, d):
    return shown(P.panel_ols(long_panel(spark, d), "y", "x", "t", "u"), "model", "n_obs", "n_units", "n_periods", estimate=4, se=4, r_squared=9)


@query("hc1_se", f"""WITH {line_ctes(LINE)}, v AS (SELECT any_value(n) AS n, sum(p0*p0*e*e) AS v00, sum(p0*p1*e*e) AS v01, sum(p1*p1*e*e) AS v11 FROM (
  SELECT n, 1.0/n - mx*(x-mx)/sxx AS p0, (x-mx)/sxx AS p1, (y-my)-b*(x-mx) AS e FROM f JOIN fit USING (g)))
SELECT n AS n_obs, round(CAST(n AS DOUBLE)/(n-2)*v00, 2) AS var_intercept, round(CAST(n AS DOUBLE)/(n-2)*v01, 4) AS cov_intercept_slope,
  round(CAST(n AS DOUBLE)/(n-2)*v11, 6) AS var_slope FROM v""")
def _(spark, d):
    return shown(R.hc1_se(lines(spark, d), Y, X), "n_obs", var_intercept=2, cov_intercept_slope=4, var_slope=6)


@query("cluster_se", f"""WITH {line_ctes(LINE.replace('0 AS g', '0 AS g, l_suppkey AS k'))},
  s AS (SELECT k, sum(p0*e) AS s0, sum(p1*e) AS s1, any_value(n) AS n FROM (
    SELECT k, n, 1.0/n - mx*(x-mx)/sxx AS p0, (x-mx)/sxx AS p1, (y-my)-b*(x-mx) AS e FROM f JOIN fit USING (g)) GROUP BY k),
  v AS (SELECT any_value(n) AS n, count(*) AS c, sum(s0*s0) AS v00, sum(s1*s1) AS v11,
    (CAST(count(*) AS DOUBLE)/(count(*)-1))*((any_value(n)-1)::DOUBLE/(any_value(n)-2)) AS k FROM s)
SELECT n AS n_obs, c AS n_clusters, round(sqrt(k*v00), 4) AS se_intercept, round(sqrt(k*v11), 6) AS se_slope FROM v""")
def _(spark, d):
    return shown(R.cluster_se(lines(spark, d), Y, X, "l_suppkey"), "n_obs", "n_clusters", se_intercept=4, se_slope=6)

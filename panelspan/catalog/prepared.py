"""Source, cleaning, reshaping and model-choice queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import prepare as PP
from ..operators import regress as R
from ..plans.scale import shared_dir
from ..sources import files as S
from ..spec import PanelSpec
from .base import LINE_BY, MONTHLY, PANEL, X, Y, line_ctes, monthly, panel, query, shown, table, wide


def _scratch(spark, suffix: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/panelspan/{uuid.uuid4().hex}{suffix}"


ORDERS_SUM = """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(min(o_orderdate) AS VARCHAR) AS first_day,
  CAST(max(o_orderdate) AS VARCHAR) AS last_day FROM orders GROUP BY 1"""


def _orders_sum(df):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")     # noqa: E731
    return df.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"))


def _orders_as_text(spark, d):
    """Orders with the date as text (days, written with dashes)."""
    o = table(spark, d, "orders")
    return o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("read_csv", ORDERS_SUM)
def _(spark, d):
    path = _scratch(spark, ".csv")
    S.write_results(_orders_as_text(spark, d), path, "csv")
    return _orders_sum(S.read_csv(spark, path))


@query("read_tsv", ORDERS_SUM)
def _(spark, d):
    path = _scratch(spark, ".tsv")
    _orders_as_text(spark, d).write.option("header", True).option("sep", "\t").csv(path)
    return _orders_sum(S.read_tsv(spark, path))


@query("read_parquet", ORDERS_SUM)
def _(spark, d):
    return _orders_sum(S.read_parquet(spark, f"{d}/orders.parquet"))


@query("load_table", ORDERS_SUM)
def _(spark, d):
    return _orders_sum(S.load_table(spark, f"{d}/orders.parquet"))


@query("sniff_dates", ORDERS_SUM)
def _(spark, d):
    return _orders_sum(S.sniff_dates(_orders_as_text(spark, d)))


@query("write_results", f"WITH {line_ctes(LINE_BY)} SELECT g AS l_returnflag, 'ols' AS model, n AS n_obs, round(b, 6) AS estimate FROM fit")
def _(spark, d):
    path = _scratch(spark, "")
    S.write_results(R.ols(table(spark, d, "lineitem"), Y, X, ["l_returnflag"]), path, "json", partition_by=["model"])
    back = spark.read.json(path)
    return shown(back, "l_returnflag", "model", "n_obs", estimate=6)


@query("clean_numeric", """SELECT p_type, count(*) AS n, round(sum(p_retailprice), 4) AS sum_y, CAST(sum(CAST(split_part(p_brand, '#', 2) AS DOUBLE)) AS DOUBLE) AS sum_x
  FROM part WHERE TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) IS NOT NULL AND p_type IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY 1""")
def _(spark, d):
    p = table(spark, d, "part").withColumn("brand_no", F.split_part("p_brand", F.lit("#"), F.lit(2)))
    from ..functions.columns import clean_numeric
    f = clean_numeric(p, {"y": "p_retailprice", "x": "brand_no"}, keep=["p_type"])
    return f.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("sum_y"), F.sum("x").alias("sum_x"))


@query("filter_unit", f"WITH {MONTHLY} SELECT m AS time, round(avg(o_totalprice), 4) AS y, count(*) AS n FROM monthly WHERE o_orderpriority = '2-HIGH' GROUP BY 1")
def _(spark, d):
    s = PP.series_by_time(PP.filter_unit(monthly(spark, d), "o_orderpriority", "2-HIGH"), "o_totalprice", "m")
    return s.select(F.col("time").cast("int").alias("time"), F.round("y", 4).alias("y"), "n")


@query("filter_positive", "SELECT event_type, count(*) AS n, round(min(value), 4) AS smallest FROM events WHERE value > 0 GROUP BY 1")
def _(spark, d):
    e = PP.filter_positive(table(spark, d, "events"), "value")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 4).alias("smallest"))


LONG = """long AS (SELECT n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS price,
  avg(CASE WHEN o_orderpriority='1-URGENT' THEN 1.0 ELSE 0.0 END) AS urgent FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
  WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2),
  grid AS (SELECT country, year, price, urgent FROM (SELECT DISTINCT country, k.year FROM long, (SELECT unnest(generate_series(1995, 2001)) AS year) k) LEFT JOIN long USING (country, year))"""


@query("unpivot_years", f"""WITH {LONG} SELECT country, 'Average order price' AS indicator, CAST(year AS INTEGER) AS year, round(price, 4) AS value FROM grid
  UNION ALL SELECT country, 'Share of urgent orders', CAST(year AS INTEGER), round(urgent, 4) FROM grid""")
def _(spark, d):
    return PP.unpivot_years(wide(spark, d)).withColumn("value", F.round("value", 4))


@query("indicator_filter", f"WITH {LONG} SELECT country, CAST(year AS INTEGER) AS year, round(urgent, 9) AS value FROM grid")
def _(spark, d):
    long = PP.indicator_filter(PP.unpivot_years(wide(spark, d)), "indicator", "URGENT orders")
    return long.select("country", "year", F.round("value", 9).alias("value"))


@query("indicator_join", f"WITH {LONG} SELECT country, CAST(year AS INTEGER) AS year, round(price, 4) AS \"order price\", round(urgent, 9) AS urgent FROM grid")
def _(spark, d):
    j = PP.indicator_join(PP.unpivot_years(wide(spark, d)), "country", "indicator", "order price", "urgent")
    return j.select("country", "year", F.round("order price", 4).alias("order price"), F.round("urgent", 9).alias("urgent"))


@query("find_indicator_column", "SELECT 'indicator' AS indicator_column, CAST(2 AS BIGINT) AS n_unique FROM (SELECT count(*) FROM orders)")
def _(spark, d):
    return PP.find_indicator_column(wide(spark, d))


@query("treatment_varies", """SELECT sum(CASE WHEN v THEN 1 ELSE 0 END) > 0 AS varies, CAST(sum(CASE WHEN v THEN 1 ELSE 0 END) AS BIGINT) AS units_varying, count(*) AS n_units
  FROM (SELECT l_suppkey, count(DISTINCT l_quantity) > 1 AS v FROM lineitem GROUP BY 1)""")
def _(spark, d):
    return PP.treatment_varies(table(spark, d, "lineitem"), X, "l_suppkey")


@query("positivity_check", """SELECT event_type, 'value' AS "column", count(value) AS n, round(min(value), 6) AS smallest, min(value) > 0 AS positive FROM events GROUP BY 1
  UNION ALL SELECT event_type, 'user_id', count(user_id), CAST(min(user_id) AS DOUBLE), min(user_id) > 0 FROM events GROUP BY 1""")
def _(spark, d):
    r = PP.positivity_check(table(spark, d, "events"), ["value", "user_id"], ["event_type"])
    return r.withColumn("smallest", F.round("smallest", 6))


ADMISSIBLE = """a AS (SELECT event_type, min(value) > 0 AS yp, min(user_id) > 0 AS xp FROM events GROUP BY 1),
  w AS (SELECT event_type, max(CASE WHEN lo < hi THEN 1 ELSE 0 END) = 1 AS varies FROM (
    SELECT event_type, dayofmonth(ts) AS k, min(user_id) AS lo, max(user_id) AS hi FROM events GROUP BY 1, 2) GROUP BY 1),
  c AS (SELECT event_type, model, CAST(rank AS INTEGER) AS rank, CASE
      WHEN model IN ('panel_ols', 'first_difference') THEN 'Missing required fields: time' WHEN model = 'time_fe' THEN 'Missing required fields: time'
      WHEN model = 'entity_fe' AND NOT varies THEN 'Predictor ''user_id'' does not vary within units'
      WHEN model IN ('log_linear', 'log_log') AND NOT yp THEN 'Outcome ''value'' must be strictly positive'
      WHEN model = 'log_log' AND NOT xp THEN 'Predictor ''user_id'' must be strictly positive' END AS reason
    FROM a JOIN w USING (event_type), (VALUES ('panel_ols', 1), ('entity_fe', 2), ('time_fe', 3), ('first_difference', 4), ('ols', 5), ('pooled_ols', 6),
      ('log_linear', 7), ('log_log', 8), ('polynomial_ols', 9), ('median_quantile', 10)) v(model, rank))"""


def _events(spark, d):
    return table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))


@query("admissible_models", f"WITH {ADMISSIBLE} SELECT event_type, model, rank, CASE WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END AS status, reason FROM c")
def _(spark, d):
    return PP.admissible_models(_events(spark, d), PanelSpec("value", "user_id", "day"), ["event_type"])


@query("choose_model", f"""WITH {ADMISSIBLE}, v AS (SELECT * FROM c WHERE reason IS NULL), b AS (SELECT event_type, arg_min(model, rank) AS model FROM v GROUP BY 1)
SELECT event_type, b.model, CASE b.model WHEN 'entity_fe' THEN 'Entity fixed effects' ELSE 'OLS (cross-sectional)' END AS display_name,
  string_agg(v.model, ',' ORDER BY rank) FILTER (v.model <> b.model) AS alternatives, CAST(NULL AS VARCHAR) AS error FROM b JOIN v USING (event_type) GROUP BY 1, 2""")
def _(spark, d):
    return PP.choose_model(PP.admissible_models(_events(spark, d), PanelSpec("value", "user_id", "day"), ["event_type"]), ["event_type"])


@query("lag_predictor", f"WITH {PANEL} SELECT u, t, round(lag(x) OVER (PARTITION BY u ORDER BY t), 9) AS x_lag1 FROM panel")
def _(spark, d):
    r = PP.lag_predictor(panel(spark, d), "x", "t", "u")
    return r.select("u", "t", F.round("x_lag1", 9).alias("x_lag1"))


@query("pick_time_column", """SELECT 'yr' AS time_column, count(*) AS n FROM orders
  HAVING avg(year(o_orderdate)) BETWEEN 1800 AND 2100 AND stddev(year(o_orderdate)) < 50""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"), "o_totalprice")
    found = PP.pick_time_column(o)
    return o.agg(F.count(found).alias("n")).select(F.lit(found).alias("time_column"), "n")


@query("numeric_outcome_fallback", "SELECT 'o_orderkey' AS outcome, count(*) AS n FROM orders HAVING count(DISTINCT o_orderkey) > 5")
def _(spark, d):
    o = table(spark, d, "orders")
    found = PP.numeric_outcome_fallback(o, "o_orderpriority")
    return o.agg(F.count(found).alias("n")).select(F.lit(found).alias("outcome"), "n")


@query("sample_pairs", """SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS x FROM lineitem
  ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 600""")
def _(spark, d):
    return PP.sample_pairs(table(spark, d, "lineitem"), Y, X, ["l_orderkey", "l_linenumber"])


@query("resolve_unit", """WITH q AS (SELECT DISTINCT 'The Kingdom of ' || lower(n_name) AS request FROM nation UNION SELECT DISTINCT lower(r_name) || ' region' FROM region
    UNION SELECT DISTINCT c_name FROM customer),
  u AS (SELECT DISTINCT n_name AS unit FROM nation),
  cl AS (SELECT request, trim(replace(replace(lower(request), 'kingdom of', ''), 'the ', ''), ' ,') AS c FROM q),
  m AS (SELECT request, unit, CASE WHEN request = unit THEN 3.0 WHEN c = lower(unit) THEN 2.0
      WHEN length(c) > 3 AND (contains(c, lower(unit)) OR contains(lower(unit), c)) THEN 1/(1+0.1*(1+length(unit)-length(replace(unit, ' ', '')))) END AS score FROM cl, u)
SELECT request, arg_max(unit, (score, -length(unit), unit)) AS unit, round(max(score), 9)::DOUBLE AS score FROM m WHERE score IS NOT NULL GROUP BY 1""")
def _(spark, d):
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    asked = (n.select(F.concat(F.lit("The Kingdom of "), F.lower("n_name")).alias("request"))
             .union(r.select(F.concat(F.lower("r_name"), F.lit(" region")))).union(c.select("c_name")))
    return PP.resolve_unit(n, "n_name", asked, "request").withColumn("score", F.round("score", 9))

"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PR
from ..operators import tables as TB
from .base import MONTHLY, query, rounded, shown, table, wide

# name, is number, is integer, is date
CUSTOMER = (("c_custkey", 1, 1, 0), ("c_name", 0, 0, 0), ("c_nationkey", 1, 1, 0), ("c_acctbal", 1, 0, 0), ("c_mktsegment", 0, 0, 0))
ORDERS = (("o_orderkey", 1, 1, 0), ("o_custkey", 1, 1, 0), ("o_orderstatus", 0, 0, 0), ("o_totalprice", 1, 0, 0), ("o_orderdate", 0, 0, 1),
          ("o_orderpriority", 0, 0, 0))


def _facts(name: str, columns) -> str:
    """One row per column with the facts and the semantic type."""
    parts = []
    for i, (c, number, whole, dated) in enumerate(columns):
        v = f"CAST({c} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS name, {i} AS position, count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique,
    min({v}) AS lo, max({v}) AS hi, avg({v}) AS mean, stddev_samp({v}) AS std, {number} AS number, {whole} AS whole, {dated} AS dated,
    coalesce(bool_and(lower(CAST({c} AS VARCHAR)) IN ('true', 'false', '0', '1', '0.0', '1.0')), false) AS flags,
    coalesce(bool_and(coalesce({v} = floor({v}) AND {v} BETWEEN 1800 AND 2100, false)), false) AS years FROM {name}""")
    return f"""facts AS ({' UNION ALL '.join(parts)}), p AS (SELECT *, CASE WHEN n_rows = n_missing THEN 'text' WHEN dated = 1 THEN 'datetime'
    WHEN flags AND n_unique <= 2 THEN 'boolean' WHEN years AND n_unique <= 200 THEN 'year' WHEN whole = 1 AND n_unique <= 30 THEN 'categorical'
    WHEN whole = 1 THEN 'integer' WHEN number = 1 THEN 'numeric' WHEN n_unique = n_rows - n_missing AND n_unique > 5 THEN 'identifier'
    WHEN n_unique <= greatest(50, floor(n_rows*0.05)) THEN 'categorical' ELSE 'text' END AS kind FROM facts)"""


@query("column_stats", f"""WITH {_facts('orders', ORDERS)} SELECT name, CAST(position AS INTEGER) AS position, n_rows, n_unique, n_missing, 100.0*n_missing/n_rows AS missing_pct,
  CASE WHEN kind IN ('numeric', 'integer', 'year') THEN round(lo, 4) END AS min, CASE WHEN kind IN ('numeric', 'integer', 'year') THEN round(hi, 4) END AS max,
  CASE WHEN kind IN ('numeric', 'integer', 'year') THEN round(mean, 4) END AS mean, CASE WHEN kind IN ('numeric', 'integer', 'year') THEN round(std, 4) END AS std FROM p""")
def _(spark, d):
    return rounded(PR.column_stats(table(spark, d, "orders"), exact=True), min=4, max=4, mean=4, std=4)


@query("semantic_types", f"WITH {_facts('customer', CUSTOMER)} SELECT name, kind AS semantic_type FROM p")
def _(spark, d):
    return PR.semantic_types(table(spark, d, "customer"), exact=True)


@query("semantic_types_approx", f"WITH {_facts('orders', ORDERS)} SELECT name, kind AS semantic_type FROM p")
def _(spark, d):
    return PR.semantic_types(table(spark, d, "orders"))


@query("dataset_structure", f"""WITH {_facts('orders', ORDERS)}, l AS (SELECT max(n_rows) AS n_rows, count(*) AS n_cols,
    coalesce(string_agg(name, ',' ORDER BY position) FILTER (kind IN ('datetime', 'year')), '') AS time_columns,
    coalesce(string_agg(name, ',' ORDER BY position) FILTER (kind IN ('categorical', 'identifier') AND n_unique > 1), '') AS unit_columns,
    coalesce(string_agg(name, ',' ORDER BY position) FILTER (kind IN ('numeric', 'integer') AND n_missing < 0.5*n_rows AND std > 0), '') AS outcome_columns,
    coalesce(string_agg(name, ',' ORDER BY position) FILTER (kind IN ('numeric', 'integer') AND n_missing < 0.5*n_rows OR kind = 'boolean'), '') AS treatment_columns FROM p)
SELECT n_rows, n_cols, CASE WHEN time_columns <> '' AND unit_columns <> '' THEN 'panel' WHEN time_columns <> '' THEN 'time_series' ELSE 'cross_section' END AS structure,
  CAST(NULL AS VARCHAR) AS indicator_column, time_columns, unit_columns, outcome_columns, treatment_columns, '' AS year_columns,
  CASE WHEN n_rows < 20 THEN 'under 20 rows' ELSE '' END AS notes FROM l""")
def _(spark, d):
    return PR.dataset_structure(PR.column_profile(table(spark, d, "orders"), exact=True))


@query("dataset_structure_wide", """SELECT count(*)*2 AS n_rows, CAST(9 AS BIGINT) AS n_cols, 'wide_indicator' AS structure, 'indicator' AS indicator_column,
  '1995,1996,1997,1998,1999,2000,2001' AS time_columns, '1995,1996,1997,1998,1999,2000,2001' AS year_columns
  FROM (SELECT DISTINCT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)""")
def _(spark, d):
    s = PR.dataset_structure(PR.column_profile(wide(spark, d), exact=True))
    return s.select("n_rows", "n_cols", "structure", "indicator_column", "time_columns", "year_columns")


@query("profile_summary", f"""WITH {_facts('orders', ORDERS)} SELECT name, '  - ' || name || '(' || kind || ')' || CASE WHEN kind IN ('numeric', 'integer', 'year')
  THEN ' range=[' || printf('%.4e', lo) || ',' || printf('%.4e', hi) || ']' ELSE '' END || CASE WHEN n_missing > 0 THEN ' missing=' || printf('%.1f', 100.0*n_missing/n_rows) || '%' ELSE '' END AS line FROM p""")
def _(spark, d):
    return PR.profile_summary(PR.column_profile(table(spark, d, "orders"), exact=True))


@query("unit_hint", f"""WITH {_facts('orders', ORDERS)} SELECT name, CASE WHEN name LIKE '%year%' THEN 'year' WHEN name LIKE '%yr%' THEN 'year' WHEN name LIKE '%date%' THEN 'date'
  WHEN name LIKE '%usd%' THEN 'USD' WHEN name LIKE '%gdp%' THEN 'currency' WHEN name LIKE '%pct%' OR name LIKE '%percent%' OR name LIKE '%rate%' THEN '%'
  WHEN name LIKE '%count%' OR name LIKE '%n\\_%' ESCAPE '\\' THEN 'count' END AS inferred_unit FROM p""")
def _(spark, d):
    return PR.column_profile(table(spark, d, "orders")).select("name", "inferred_unit")


@query("top_values", """WITH l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
  c AS (SELECT "column", value, count(*) AS count FROM l GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""")
def _(spark, d):
    return PR.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("column_samples", """WITH l AS (SELECT DISTINCT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION SELECT DISTINCT 'c_name', c_name FROM customer),
  r AS (SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) AS INTEGER) AS rank, value FROM l) SELECT * FROM r WHERE rank <= 5""")
def _(spark, d):
    return PR.column_samples(table(spark, d, "customer"), ["c_mktsegment", "c_name"])


@query("web_profile", """SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns, 'o_orderkey,o_custkey,o_totalprice' AS numeric_columns, '' AS year_columns,
  CAST(NULL AS VARCHAR) AS likely_unit, CAST(NULL AS VARCHAR) AS likely_time, false AS is_wide_indicator FROM orders""")
def _(spark, d):
    return PR.web_profile(table(spark, d, "orders"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR = "c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]) + ")"


@query("correlation_matrix", f"WITH {CORR} SELECT a, b, round(r, 9) AS r, n FROM c")
def _(spark, d):
    return rounded(PR.correlation_matrix(table(spark, d, "lineitem"), NUMBERS), r=9)


@query("strongest_pair", f"""WITH {CORR} SELECT a, b, round(r, 9) AS r, abs(r) >= 0.4 AS called_out, CAST(NULL AS VARCHAR) AS pattern FROM c
  ORDER BY abs(r) DESC, a DESC, b DESC LIMIT 1""")
def _(spark, d):
    return rounded(TB.strongest_pair(PR.correlation_matrix(table(spark, d, "lineitem"), NUMBERS)), r=9)


@query("histogram", """WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
  b AS (SELECT l_returnflag, lo, hi, CAST(least(5, floor((l_extendedprice-lo)/((hi-lo)/6))) AS INTEGER) AS bin FROM lineitem JOIN e USING (l_returnflag))
SELECT l_returnflag, bin, round(any_value(lo) + bin*(any_value(hi)-any_value(lo))/6, 4) AS lo, round(any_value(lo) + (bin+1)*(any_value(hi)-any_value(lo))/6, 4) AS hi,
  count(*) AS count FROM b GROUP BY 1, 2""")
def _(spark, d):
    return rounded(PR.histogram(table(spark, d, "lineitem"), "l_extendedprice", by=["l_returnflag"]), lo=4, hi=4)


@query("distribution_summary", """WITH a AS (SELECT event_type, count(*) AS n, avg(value) AS mean, median(value) AS median, skewness(value) AS skew FROM events GROUP BY 1)
SELECT event_type, n, round(mean, 6) AS mean, round(median, 6) AS median, round(skew, 7) AS skew,
  CASE WHEN skew > 0.5 THEN 'right-skewed' WHEN skew < -0.5 THEN 'left-skewed' ELSE 'approx. normal' END AS shape FROM a""")
def _(spark, d):
    return rounded(PR.distribution_summary(table(spark, d, "events"), "value", ["event_type"]), mean=6, median=6, skew=7)


@query("distribution_summary_refined", """SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1""")
def _(spark, d):
    """The same median by counting passes, as used for groups beyond the built-in's bound."""
    r = PR.distribution_summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], max_rows=1000)
    return rounded(r.select("l_returnflag", "median"), median=4)


@query("sparkline", f"""WITH {MONTHLY}, e AS (SELECT o_orderpriority, min(m) AS lo, max(m) AS hi FROM monthly GROUP BY 1),
  s AS (SELECT o_orderpriority, CAST(least(23, floor(CAST(m-lo AS DOUBLE)/(hi-lo)*24)) AS INTEGER) AS slot, avg(o_totalprice) AS value FROM monthly JOIN e USING (o_orderpriority) GROUP BY 1, 2)
SELECT o_orderpriority, slot, round(value, 4) AS value, CAST(floor((value - min(value) OVER w)/(max(value) OVER w - min(value) OVER w)*7) AS INTEGER) AS level
FROM s WINDOW w AS (PARTITION BY o_orderpriority)""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("m", ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")))
    return rounded(PR.sparkline(o, "o_totalprice", "m", by=["o_orderpriority"]), value=4)

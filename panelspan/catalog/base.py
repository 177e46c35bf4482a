"""Registry, table access and the SQL pieces that several checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def shown(df: DataFrame, *keep: str, **digits: int) -> DataFrame:
    """Columns ``keep`` as they are, then the ``digits`` columns rounded."""
    return df.select(*keep, *[F.round(c, d).alias(c) for c, d in digits.items()])


# --- derived inputs -----------------------------------------------------------------------------------

EFFECT, TREATED_EVERY, START = 5000, 3, 14


def quarter_of(c: str):
    return ((F.year(c) - 1995) * 4 + F.quarter(c)).cast("int")


def month_of(c: str):
    return ((F.year(c) - 1995) * 12 + F.month(c)).cast("int")


def panel(spark, sf_dir) -> DataFrame:
    """Nation x quarter: mean order price and share of urgent orders."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)
    return (o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("u"), quarter_of("o_orderdate").alias("t"))
            .agg(F.avg("o_totalprice").alias("y"), F.avg(urgent).alias("x")))


def treated_panel(spark, sf_dir) -> DataFrame:
    """The panel with every third nation treated from a fixed quarter, and a known effect added."""
    on = (F.col("u") % TREATED_EVERY == 0) & (F.col("t") >= START)
    p = panel(spark, sf_dir).withColumn("d", F.when(on, 1).otherwise(0))
    return p.select("u", "t", (F.col("y") + EFFECT * F.col("d")).alias("y"), "d")


def long_panel(spark, sf_dir) -> DataFrame:
    """Nation x month with a part of the cells absent by nature of the data, and order rows kept."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("c_nationkey").alias("u"), month_of("o_orderdate").alias("t"), F.col("o_totalprice").alias("y"), urgent.alias("x"))


def wide(spark, sf_dir) -> DataFrame:
    """Country rows with an indicator and one column per year."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    years = [str(r[0]) for r in o.select(F.year("o_orderdate")).where("o_orderdate is not null").distinct().collect()]
    cells = rows.select(F.col("n_name").alias("country"), F.year("o_orderdate").cast("string").alias("yr"), F.explode(F.array(
        F.struct(F.lit("Average order price").alias("i"), F.col("o_totalprice").alias("v")),
        F.struct(F.lit("Share of urgent orders").alias("i"), F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0).alias("v")))).alias("c"))
    return (cells.groupBy("country", F.col("c.i").alias("indicator")).pivot("yr", sorted(years)).agg(F.avg("c.v")))


def monthly(spark, sf_dir) -> DataFrame:
    """Orders with a month index."""
    return table(spark, sf_dir, "orders").select(month_of("o_orderdate").alias("m"), "o_totalprice", "o_orderpriority")


# --- SQL pieces -----------------------------------------------------------------------------------------

PANEL = """panel AS (SELECT c.c_nationkey AS u, CAST((year(o_orderdate)-1995)*4+quarter(o_orderdate) AS INTEGER) AS t,
  avg(o_totalprice) AS y, avg(CASE WHEN o_orderpriority='1-URGENT' THEN 1.0 ELSE 0.0 END) AS x
  FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey GROUP BY 1,2)"""
TREATED = PANEL + f""", treated AS (SELECT u, t, d, y + {EFFECT}*d AS y FROM (
  SELECT u, t, y, CASE WHEN u % {TREATED_EVERY} = 0 AND t >= {START} THEN 1 ELSE 0 END AS d FROM panel))"""
MONTHLY = """monthly AS (SELECT CAST((year(o_orderdate)-1995)*12+month(o_orderdate) AS INTEGER) AS m, o_totalprice, o_orderpriority FROM orders)"""
SERIES = MONTHLY + """, s AS (SELECT g, m AS t, y, row_number() OVER (PARTITION BY g ORDER BY m) AS i, count(*) OVER (PARTITION BY g) AS n,
  lag(y) OVER (PARTITION BY g ORDER BY m) AS y1, lag(m) OVER (PARTITION BY g ORDER BY m) AS t1
  FROM (SELECT o_orderpriority AS g, m, avg(o_totalprice) AS y FROM monthly GROUP BY 1,2))"""


def line_ctes(f_sql: str) -> str:
    """CTEs for y = a + b x per ``g`` over ``f_sql`` (columns g, y, x), ending in ``fit``."""
    return f"""f AS ({f_sql}),
  m AS (SELECT g, count(*) AS n, avg(y) AS my, avg(x) AS mx FROM f GROUP BY g),
  q AS (SELECT g, any_value(n) AS n, any_value(my) AS my, any_value(mx) AS mx, sum((x-mx)*(x-mx)) AS sxx,
        sum((x-mx)*(y-my)) AS sxy, sum((y-my)*(y-my)) AS syy FROM f JOIN m USING (g) GROUP BY g),
  r AS (SELECT g, sum((x-mx)*(x-mx)*e*e) AS meat, sum(e*e) AS rss FROM (
        SELECT g, x, mx, (y-my) - sxy/sxx*(x-mx) AS e FROM f JOIN q USING (g)) GROUP BY g),
  fit AS (SELECT g, n, my, mx, sxx, sxy, syy, rss, sxy/sxx AS b, my - sxy/sxx*mx AS a,
        sqrt(CAST(n AS DOUBLE)/(n-2)*meat)/sxx AS se, 1 - rss/syy AS r2 FROM q JOIN r USING (g))"""


def line_select(f_sql: str, model: str, digits=(6, 3, 6), key: str | None = None, extra: str = "", ctes: str = "") -> str:
    """Check of one ``regression_result`` line fit: estimate, intercept, se, t, R2, n."""
    b, a, s = digits
    head = f"g AS {key}, " if key else ""
    return f"""WITH {ctes}{line_ctes(f_sql)}
SELECT {head}'{model}' AS model, 'ok' AS status, n AS n_obs, round(b, {b}) AS estimate, round(a, {a}) AS intercept,
  round(se, {s}) AS se, round(b/se, 6) AS t_stat, round(r2, 9) AS r_squared, CAST(n-2 AS DOUBLE) AS df, round(mx, 6) AS x_mean{extra} FROM fit"""


def line_shown(df: DataFrame, *keys: str, digits=(6, 3, 6), extra: tuple = ()) -> DataFrame:
    b, a, s = digits
    out = shown(df, *keys, "model", "status", "n_obs", "df", *extra, estimate=b, intercept=a, se=s, t_stat=6, r_squared=9, x_mean=6)
    return out


LINE = "SELECT 0 AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem"
LINE_BY = "SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem"
Y, X = "l_extendedprice", "l_quantity"


def normal_quantile_sql(p: str) -> str:
    """Normal quantile of the expression ``p`` by Wichura's AS 241, for p between exp(-25) and 1 - exp(-25)."""
    # The published coefficients, lowest power first.
    centre = ("3.3871328727963666080 133.14166789178437745 1971.5909503065514427 13731.693765509461125 45921.953931549871457 67265.770927008700853 33430.575583588128105 2509.0809287301226727",
              "1.0 42.313330701600911252 687.18700749205790830 5394.1960214247511077 21213.794301586595867 39307.895800092710610 28729.085735721942674 5226.4952788528545610")
    tail = ("1.42343711074968357734 4.63033784615654529590 5.76949722146069140550 3.64784832476320460504 1.27045825245236838258 0.241780725177450611770 0.0227238449892691845833 7.74545014278341407640e-4",
            "1.0 2.05319162663775882187 1.67638483018380384940 0.689767334985100004550 0.148103976427480074590 0.0151986665636164571966 5.47593808499534494600e-4 1.05075007164441684324e-9")

    def poly(values: str, x: str) -> str:
        out = "0.0::DOUBLE"
        for v in reversed(values.split()):
            out = f"({out}*{x} + {v}::DOUBLE)"
        return out

    q, far = f"(({p}) - 0.5)", f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6)"
    near = f"(0.180625 - {q}*{q})"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q}*{poly(centre[0], near)}/{poly(centre[1], near)} "
            f"ELSE sign({q})*{poly(tail[0], far)}/{poly(tail[1], far)} END")
